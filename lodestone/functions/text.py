"""Tokenising and text scalars, as column expressions; Python only where Spark has no function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..plans.storage import tidy

#: White space beyond ASCII that separates tokens, and the ASCII punctuation that does (a backslash does not). Fixed values.
SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def delimiters(keep: str = "") -> str:
    """The regular expression of one delimiter; characters of keep don't delimit."""
    return f"[{SPACES}{''.join(chr(92) + c if c in '-[]^&' else c for c in PUNCTUATION if c not in keep)}]"


def java_delimiters(keep: str = "") -> str:
    """The same class for Java, which tests characters under 256 that are listed one by one by one look-up; what is beyond is looked at in one range only."""
    low = "".join(rf"\x{ord(c):02x}" for c in f"\t\n\x0b\f\r \x85\xa0{PUNCTUATION}" if c not in keep)
    return rf"[{low}[\x{{1680}}-\x{{3000}}&&[\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]]]"


def tokens(text: Column, keep: str = "", stop_words: list[str] | None = None) -> Column:
    """Lower-cased tokens in order; a lone backslash is none. Null: no tokens."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), java_delimiters(keep), -1), F.lower), lambda x: (x != "") & (x != "\\"))
    return found if stop_words is None else without(found, stop_words)


def without(found: Column, stop_words: list[str]) -> Column:
    listed = F.array(*map(F.lit, stop_words))
    return F.filter(found, lambda x: ~F.array_contains(listed, x))


def tokenise(sentence: str, keep: str = "") -> list[str]:
    """The same for one string on the driver (queries)."""
    spaces = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    return [x.lower() for x in re.split(f"[{spaces}{''.join(re.escape(c) for c in PUNCTUATION if c not in keep)}]", sentence) if x and x != "\\"]


def english_stop_words() -> list[str]:
    """Spark's list; words with an apostrophe can't be tokens."""
    return sorted(w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w)


@F.pandas_udf(StringType())
def unicode_normalise(text: pd.Series) -> pd.Series:
    """Canonical decomposition, ASCII only."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFD", x).encode("ascii", "ignore").decode())


def named_words(text: Column) -> Column:
    """Letters in front of a colon, each match (vocabulary lists)."""
    return F.regexp_extract_all(text, F.lit("([a-zA-Z]+):"), F.lit(1))


class Porter:
    """Suffix stripping after Porter (1980)."""

    STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
    STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
    STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

    @staticmethod
    def shape(stem: str) -> str:
        out = ""
        for i, c in enumerate(stem):
            out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
        return out

    def measure(self, stem: str) -> int:
        return len(re.findall("v+c+", self.shape(stem)))

    def short(self, stem: str) -> bool:
        return self.shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    def swap(self, word: str, table: dict[str, str]) -> str:
        for suffix in sorted(table, key=len, reverse=True):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                return stem + table[suffix] if self.measure(stem) else word
        return word

    def __call__(self, w: str) -> str:
        if len(w) < 3:
            return w
        for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(suffix):
                w = w[: len(w) - len(suffix)] + new
                break
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and "v" in self.shape(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w[-2:] in ("at", "bl", "iz"):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and self.shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.short(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in self.shape(w[:-1]):
            w = w[:-1] + "i"
        w = self.swap(self.swap(w, self.STEP2), self.STEP3)
        for suffix in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if self.measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e") and (self.measure(w[:-1]) > 1 or self.measure(w[:-1]) == 1 and not self.short(w[:-1])):
            w = w[:-1]
        return w[:-1] if w.endswith("ll") and self.measure(w) > 1 else w


def pieces(path: str):
    """A function of a text column: its pieces under the SentencePiece model at a path that every executor reads. Null: null."""

    @F.pandas_udf(ArrayType(StringType()))
    def encoded(found: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        for part in found:
            yield part.map(lambda x: None if x is None else model.encode(x, out_type=str))

    return encoded


@F.pandas_udf(ArrayType(StringType()))
def stems(found: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Porter stems of an array of tokens."""
    stem, memo = Porter(), {}

    def stemmed(w: str) -> str:
        if w not in memo:
            if len(memo) >= 200_000:
                memo.clear()
            memo[w] = stem(w)
        return memo[w]

    for part in found:
        yield part.map(lambda ws: None if ws is None else [stemmed(w) for w in ws])
    tidy()


MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def headline_parts(headline: Column) -> tuple[Column, Column, Column]:
    """source, date (dd/MON/yy) and title of 'SOURCE  dd MON yy / title'; nulls where the form isn't met."""
    part = lambda n: F.nullif(F.regexp_extract(headline, r"^(\S+) +(\d{1,2} [A-Z]{3} \d{2}) / (.*)$", n), F.lit(""))
    return part(1), F.replace(part(2), F.lit(" "), F.lit("/")), part(3)


def short_date(date: Column) -> Column:
    """Date of dd/MON/yy: years over 24 are of the last century."""
    parts = F.split(date, "/")
    year = F.get(parts, F.lit(2)).cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.get(parts, F.lit(1))).cast("int")
    return F.make_date(F.when(year > 24, year + 1900).otherwise(year + 2000), month, F.get(parts, F.lit(0)).cast("int"))


#: Names and labels of entities by form, where no model is given. Fixed values.
ENTITY_PATTERNS = (("DATE", r"\b\d{1,2} [A-Z][a-z]+ \d{4}\b"), ("MONEY", r"[$€£]\d+(?:[.,]\d+)*"), ("PERCENT", r"\d+(?:[.,]\d+)*%"), ("TIME", r"\b\d{1,2}:\d{2}\b"), ("ORDINAL", r"\b\d+(?:st|nd|rd|th)\b"), ("CARDINAL", r"\b\d+(?:[.,]\d{3})*\b"), ("ORG", r"\b[A-Z]{2,5}\b"), ("NAME", r"\b(?:[A-Z][a-z]+ )+[A-Z][a-z]+\b"))


def entities(text: Column) -> Column:
    """array<struct<text, label>> of the entities found by form."""
    labelled = lambda label: lambda x: F.struct(x.alias("text"), F.lit(label).alias("label"))
    return F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), labelled(label)) for label, p in ENTITY_PATTERNS))

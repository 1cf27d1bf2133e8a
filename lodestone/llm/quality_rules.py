"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are runs of characters other than space and U+0009 to U+000D. Every count is over the whole text.
Null and empty texts have no words, so all counts are 0 and the base rule rejects them. Rows are independent:
repeated rows, ties and repeated or null ids give a row each; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT

#: Function words of the corpus languages, by language. Fixed values.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was with you not have he his".split(),
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "le la les de des du un une et est en dans que qui pour par sur au pas avec ce il ne se".split(),
    "es": "el la los las de del que y en un una por con para se no su al lo como es más".split(),
}
SYMBOLS = r"#*$%&|<>"


class Rule(NamedTuple):
    """A ratio (numerator over denominator, both count columns) that has to lie in [low, high]."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", 0.0, 0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.6),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.0, 0.5),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array, first occurrences included.

    Windows are sorted by a hash, then by their words (compared where hashes meet), then by position, so equal ones are
    neighbours; of the flagged positions p, in order, each covers min(3, next - p) words.
    """
    three = ("a", "b", "c")

    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(3))).alias("h"), *(F.get(w, i + k).alias(c) for k, c in enumerate(three)), i.alias("i"))))

    def flagged(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            found = x["h"].eqNullSafe(F.get(s, k)["h"])
            for c in three:
                found &= x[c].eqNullSafe(F.get(s, k)[c])
            return found

        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))), F.lit(0), lambda a, b: a + b)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(let(windows(w), flagged), covered)))


def counts(docs: DataFrame) -> DataFrame:
    """The counts that the rules refer to: one projection over doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    staged = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.array_remove(F.split("text", WORD_SPLIT), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    long = lambda c: c.cast("long")
    removed = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    return staged.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(removed(r"[^#*$%&|<>]+")).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(removed(r"[^!]+")).alias("n_shouts"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(stop)))).alias("n_stop_words"),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Counts, the base rule's verdict, each rule's verdict (failed: names of the rules broken) and kept."""
    n = F.col("n_words")
    base = (n < least_words) | (F.col("n_repeat_words") * 100 > n * most_repeated)
    broken = F.array_compact(F.array(*(F.when(~F.coalesce((F.col(r.numerator) / F.nullif(F.col(r.denominator), F.lit(0))).between(r.low, r.high), F.lit(True)), F.lit(r.name)) for r in rules)))
    judged = counts(docs).select("*", base.alias("base_failed"), broken.alias("failed"))
    return judged.select("*", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))

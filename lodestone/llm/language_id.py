"""Language identification by hierarchical discrimination.

First the family, by one-versus-rest linear support vector machines; then, inside the family, one-versus-one linear
support vector machines between its languages, by votes and, at equal votes, by summed margins. Features are hashed
1- to 3-grams of the bytes of the lower-cased whole text, square roots of their shares.

A language without a family in FAMILIES is a family of its own. A text that is null or has no letter is `und` with
score 0. score is the logistic of the smaller of the winning margins. Without training rows every text is `und`.
Text in a language that wasn't learnt gets the nearest one's name, with a small margin; `least` of the model is a score
that tells it from the languages learnt: LEAST_SHARE of the margin that nearly all training rows pass.
Rows are independent; columns besides doc_id, text and (in training) lang are not read.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, rows_where

#: Families of languages by ISO 639-1 code. Fixed values.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "semitic": "ar he am mt".split(),
    "indo-aryan": "hi bn ur pa gu mr ne".split(),
}
WIDTH = 2048
#: Training rows that a fit uses at most (about), and rows of a language that stay whatever the number of languages.
BOUND, LEAST_ROWS = 6_000, 50
#: Share of a training margin that text of a learnt language has at least, and the quantile of training margins it is taken of.
LEAST_SHARE, LEAST_QUANTILE = 0.2, 0.01
_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    counts = np.bincount(b, minlength=WIDTH) + np.bincount(two >> np.uint32(21), minlength=WIDTH) + np.bincount(three >> np.uint32(21), minlength=WIDTH)
    return np.sqrt(counts / len(b), dtype=np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, at: np.ndarray | None = None, rounds: int = 12, c: float = 20.0, seed: int = 11) -> np.ndarray:
    """Weights (the last is the bias) of an L2 support vector machine with hinge loss, by dual coordinate descent. y: -1 or 1, of the rows `at` of x, or all. Rows are widened to float32 one at a time, so x is never copied."""
    at = np.arange(len(x)) if at is None else at
    alpha, w, draw = np.zeros(len(at)), np.zeros(x.shape[1] + 1, np.float32), np.random.default_rng(seed)
    norms = [float(row @ row) + 1 for row in (x[k].astype(np.float32) for k in at)]
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) / len(y) * 2 * c  # classes weigh the same
    for _ in range(rounds):
        for i in draw.permutation(len(at)):
            row = x[at[i]].astype(np.float32)
            new = min(max(alpha[i] + (1 - y[i] * (row @ w[:-1] + w[-1])) / norms[i], 0.0), share[i])
            if new != alpha[i]:
                by = np.float32((new - alpha[i]) * y[i])
                w[:-1] += by * row
                w[-1] += by
                alpha[i] = new
    return w


class Hierarchy(NamedTuple):
    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]
    least: float = 0.5

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not _LETTER.search(text):
            return "und", 0.0
        language, margin = self.decide(np.append(features(text), np.float32(1)))
        return language, logistic(margin)

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """(language, the smaller of the winning margins) of features with a last 1."""
        margin, family = np.inf, self.families[0]
        if len(self.families) > 1:
            margins = self.family_weights @ x
            best = int(margins.argmax())
            family, margin = self.families[best], float(margins[best] - np.partition(margins, -2)[-2]) / 2
        languages = self.languages[family]
        if len(languages) == 1:
            return languages[0], margin
        votes, sums = np.zeros(len(languages)), np.zeros(len(languages))
        m = self.pair_weights[family] @ x
        for (a, b), v in zip(self.pairs[family], m, strict=True):
            votes[a if v >= 0 else b] += 1
            sums[a] += v
            sums[b] -= v
        best = max(range(len(languages)), key=lambda k: (votes[k], sums[k]))
        own = [abs(float(v)) * (1 if (v >= 0) == (a == best) else -1) for (a, b), v in zip(self.pairs[family], m, strict=True) if best in (a, b)]
        return languages[best], min(margin, *own)


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-2 * min(max(x, -15.0), 15.0))))


def fit(texts: np.ndarray, langs: list[str]) -> Hierarchy:
    """texts: rows of features."""
    of = {code: family for family, codes in FAMILIES.items() for code in codes}
    languages: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        languages.setdefault(of.get(lang, f"only {lang}"), []).append(lang)
    families, langs = sorted(languages), np.array(langs, object)
    family = np.array([of.get(x, f"only {x}") for x in langs], object)
    whole = np.array([linear_svm(texts, np.where(family == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((1, WIDTH + 1))
    pairs = {f: list(combinations(range(len(v)), 2)) for f, v in languages.items()}
    weights = {}
    for f, v in languages.items():
        rows = []
        for a, b in pairs[f]:
            at = np.flatnonzero((langs == v[a]) | (langs == v[b]))
            rows.append(linear_svm(texts, np.where(langs[at] == v[a], 1, -1), at))
        weights[f] = np.array(rows, np.float32)
    model = Hierarchy(families, whole.astype(np.float32), languages, pairs, weights)
    return model._replace(least=least_score(model, texts, langs))


def least_score(model: Hierarchy, texts: np.ndarray, langs: np.ndarray) -> float:
    """The score under which text is in none of the languages, from the margins of training rows that get their own language; 0.5 where one language or no row is known, as there is nothing to tell it from."""
    if len(langs) == 0 or sum(map(len, model.languages.values())) < 2:
        return 0.5
    found = [model.decide(np.append(x, np.float32(1))) for x in texts]
    own = [margin for (lang, margin), known in zip(found, langs, strict=True) if lang == known]
    return logistic(LEAST_SHARE * max(0.0, float(np.quantile(own, LEAST_QUANTILE)))) if own else 0.5


def quotas(sizes: dict[str, int], bound: int) -> dict[str, int]:
    """Rows to take of each language: all of the small ones, and what they leave of bound in equal parts of the others; LEAST_ROWS at least, if there are so many."""
    out: dict[str, int] = {}
    left = bound
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        own = min(n, left // (len(sizes) - k))
        left -= own
        out[lang] = min(n, max(own, LEAST_ROWS))
    return out


def train(docs: DataFrame, keep: Column, bound: int = BOUND) -> Hierarchy:
    """Fits on about bound documents with a language that satisfy keep, dealt over the languages; only their features reach the driver."""

    def kernel(columns: list[pa.Array]) -> list:
        return [columns[1], [features(t).astype(np.float16).tobytes() for t in columns[2].to_pylist()]]

    known = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) > bound:
        taken = docs.sparkSession.createDataFrame([(lang, int(n / sizes[lang] * (1 << 30))) for lang, n in quotas(sizes, bound).items()], "lang string, most bigint")
        known = known.join(F.broadcast(taken), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.col("most")).select("doc_id", "lang", "text")
    rows = sorted(by_batch(known, kernel, "lang string, x binary").collect(), key=lambda r: (r.lang, r.x))
    langs, x = [r.lang for r in rows], np.empty((len(rows), WIDTH), np.float16)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r.x, np.float16)
    del rows
    return fit(x, langs)


class _Kernel:
    def __init__(self, model: Hierarchy):
        self.model = model

    def __call__(self, columns: list[pa.Array]) -> list:
        found = [self.model.predict(t) for t in columns[1].to_pylist()]
        return [columns[0], [x for x, _ in found], [s for _, s in found]]


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, lang_pred, score: one row per document."""
    return by_batch(docs.select("doc_id", "text"), _Kernel(model), "doc_id bigint, lang_pred string, score double")


def filtered(docs: DataFrame, model: Hierarchy, least: float) -> DataFrame:
    """The documents, with all their columns, that have a language with a score of at least `least` and the model's own least score."""
    least = max(least, model.least)
    return rows_where(docs, lambda texts: [lang != "und" and score >= least for lang, score in map(model.predict, texts)])

"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in its features. All preference pairs (a document labelled 1 beats one labelled 0) fit
the weights by logistic loss on feature differences; their sums are made from sums by strength, so no pair is a row. A quantile of the training strengths, at the share of labels 0, is
the threshold; scores are the logistic of the distance from it, set so that the threshold scores 0.3.

Features read the whole text. Null and empty texts have all features 0. Labels with a null id or value are left out; of
several for a document the largest counts. Without both labels in training, every score is the share of label 1 (0.5
without any label). Rows are independent; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, discard, pa_schema, rows_where, written

#: Labelled rows whose features the driver sums up itself; more are summed up by tasks, at most so many.
LOCAL, TASKS = 20_000, 16
#: Places on the range of the strengths by which rows are summed up.
BINS = 4096
#: Features of a text.
WIDTH = 14
ROWS = "x array<double>, y int"
CUT = 0.3
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>@^~=+_{}[]\\/"


def features(text: str | None) -> list[float]:
    """Ratios as square roots, so that a little junk in a long text shows; sizes as logarithms."""
    if not text:
        return [0.0] * WIDTH
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    size, n = len(raw), len(words)
    if not n:
        return [0.0] * WIDTH
    lost = lambda gone: (size - len(raw.translate(None, gone))) / size
    runs = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(words))
    ends = sum(raw.count(x) for x in (b".", b"?"))
    return [
        np.log1p(n),
        np.log1p(size / n),
        np.sqrt(lost(_SYMBOLS)),
        np.sqrt(raw.count(b"!") / n),
        np.sqrt(lost(_UPPER)),
        np.sqrt(sum(x.isupper() and len(x) > 1 for x in words) / n),
        np.sqrt(raw.count(b" | ") / n),
        np.sqrt(runs / n),
        distinct / n,
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.sqrt(lost(_DIGIT)),
        np.log1p(n / max(1, len(lines))),
        np.sqrt(ends / n),
        np.sqrt(lost(b",;:")),
    ]


class Ranking(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    constant: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """x: rows of features."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        s = self.strength(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(self.slope * s + np.log(CUT / (1 - CUT)), -30, 30)))

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


#: What a pass over the labelled rows brings: numbers to add up (whole, so that their order is no matter), least and largest ones.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]
Pass = Callable[[Callable[[np.ndarray, np.ndarray], Part]], Part]
_NONE = np.empty(0)


def merged(parts: Iterable[Part]) -> Part:
    return functools.reduce(lambda a, b: (a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])), parts)


def whole(x: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(x * (1 << bits)).astype(np.int64)


def strengths(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = (x - mean) / scale
    return z, (z * w).sum(1)


class Moments:
    """Rows, rows of label 1 and 0, sums of features and of their products; least and largest features."""

    def __call__(self, x: np.ndarray, y: np.ndarray) -> Part:
        sums = [np.array([len(y), (y == 1).sum(), (y == 0).sum()]), whole(x, 24).sum(0), whole(x[:, :, None] * x[:, None, :], 24).sum(0).ravel()]
        edge = np.full((1, WIDTH), np.inf)
        return np.concatenate(sums), np.concatenate([x, edge]).min(0), np.concatenate([x, -edge]).max(0)


class Binned(NamedTuple):
    """For label 1 and 0 and each of BINS places on the strengths' range: rows and sums of features, a row shared by its two nearest places."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    low: float
    step: float

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, s = strengths(x, self.mean, self.scale, self.w)
        at = np.clip((s - self.low) / self.step, 0, BINS - 1)
        k = np.minimum(at.astype(np.int64), BINS - 2)
        return z, k, at - k

    def __call__(self, x: np.ndarray, y: np.ndarray) -> Part:
        z, k, f = self.places(x)
        z1 = np.concatenate([np.ones((len(z), 1)), z], 1)
        out = np.zeros((2, BINS, WIDTH + 1), np.int64)
        for side, own in enumerate((y == 1, y == 0)):
            for at, share in ((k, 1 - f), (k + 1, f)):
                np.add.at(out[side], at[own], whole(z1[own] * share[own, None], 24))
        return out.ravel(), _NONE, _NONE


class Curved(NamedTuple):
    """Sums of products of features, weighted by a function of the strength for label 1 and another for label 0."""

    binned: Binned
    of: np.ndarray

    def __call__(self, x: np.ndarray, y: np.ndarray) -> Part:
        z, k, f = self.binned.places(x)
        out = np.zeros((WIDTH, WIDTH), np.int64)
        for side, own in enumerate((y == 1, y == 0)):
            v = (self.of[side][k] * (1 - f) + self.of[side][k + 1] * f)[own]
            out += whole(z[own][:, :, None] * z[own][:, None, :] * v[:, None, None], 26).sum(0)
        return out.ravel(), _NONE, _NONE


class Counted(NamedTuple):
    """Rows in each of BINS equal parts of a range of strengths, those before it and all beyond; least and largest strength of each."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    low: float
    high: float

    def __call__(self, x: np.ndarray, y: np.ndarray) -> Part:
        _, s = strengths(x, self.mean, self.scale, self.w)
        at = np.searchsorted(np.linspace(self.low, self.high, BINS + 1), s, "right")
        least, most = np.full(BINS + 2, np.inf), np.full(BINS + 2, -np.inf)
        np.minimum.at(least, at, s)
        np.maximum.at(most, at, s)
        return np.bincount(at, minlength=BINS + 2), least, most


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def convolved(kernel: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """out[k] = sum over l of kernel[l - k + BINS - 1] * rows[l], by columns."""
    size = 4 * BINS
    out = np.fft.irfft(np.fft.rfft(kernel[::-1], size)[:, None] * np.fft.rfft(rows, size, axis=0), size, axis=0)
    return out[BINS - 1 : 2 * BINS - 1]


def learnt(over: Pass, l2: float = 1e-3) -> Ranking:
    """over(kernel) is kernel's Part of all labelled rows. Every pair of a row with label 1 and one with label 0 counts.

    A pair's loss depends on the difference of two strengths. Rows are summed up by strength in BINS places, and the
    pairs of all places are a convolution. Sharing a row between two places errs by less than a hundredth of the square
    of their distance, which is the range of the strengths over BINS.
    """
    sums, least, most = over(Moments())
    (n, better, worse), total, square = sums[:3].tolist(), sums[3 : 3 + WIDTH] / (1 << 24), sums[3 + WIDTH :].reshape(WIDTH, WIDTH) / (1 << 24)
    if not better or not worse:
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 1.0, better / n if n else 0.5)
    mean = total / n
    covariance = square / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale = np.where(most - least > 1e-6, np.maximum(scale, 1e-6), 1.0)  # a feature that never varies is 0
    ends, w = np.stack([(least - mean) / scale, (most - mean) / scale]), np.zeros(WIDTH)
    for _ in range(25):  # Newton's method on the mean logistic loss of all pairs
        low, high = (ends * w).min(0).sum() - 1e-6, (ends * w).max(0).sum() + 1e-6
        binned = Binned(mean, scale, w, float(low), float((high - low) / (BINS - 1)))
        one, zero = over(binned)[0].reshape(2, BINS, WIDTH + 1) / (1 << 24)
        one, zero = one / better, zero / worse
        q = logistic(np.arange(1 - BINS, BINS) * binned.step)  # how wrong a pair is, by the strength of 0 less that of 1
        slope, curve = q, q * (1 - q)
        lost, won = convolved(slope, zero[:, :1]), convolved(slope[::-1], one[:, :1])
        gradient = (won * zero[:, 1:]).sum(0) - (lost * one[:, 1:]).sum(0)
        bent = convolved(curve, zero)
        of = np.stack([bent[:, 0] / better, convolved(curve[::-1], one[:, :1])[:, 0] / worse])
        cross = one[:, 1:].T @ bent[:, 1:]
        size = max(better, worse)
        hessian = over(Curved(binned, of * size))[0].reshape(WIDTH, WIDTH) / (1 << 26) / size - cross - cross.T
        step = np.linalg.solve(hessian + l2 * np.eye(WIDTH), gradient + l2 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    k = min(max(1, worse), n - 1)
    ends = ends * w
    bounds = float(ends.min(0).sum()) - 1e-6, float(ends.max(0).sum()) + 1e-6
    threshold = sum(ranked(over, Counted(mean, scale, w, *bounds), r) for r in (k - 1, k)) / 2
    return Ranking(mean, scale, w, threshold, 4 / (float(np.sqrt(max(0.0, (w / scale) @ covariance @ (w / scale)))) + 1e-9), None)


def ranked(over: Pass, counted: Counted, rank: int) -> float:
    """The strength with so many before it in order, by ever smaller ranges that hold it."""
    while True:
        count, least, most = over(counted)
        at = int(np.searchsorted(np.cumsum(count), rank, "right"))
        if least[at] == most[at]:
            return float(least[at])
        counted = counted._replace(low=float(least[at]), high=float(np.nextafter(most[at], np.inf)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> Ranking:
    x, y = np.asarray(x, float).reshape(len(y), WIDTH), np.asarray(y)
    return learnt(lambda kernel: kernel(x, y), l2)


class _Kernel:
    def __init__(self, model: Ranking | None):
        self.model = model

    def __call__(self, columns: list[pa.Array]) -> list:
        x = np.array([features(t) for t in columns[1].to_pylist()]).reshape(len(columns[1]), WIDTH)
        if self.model is None:
            return [columns[0], x.tolist()]
        return [columns[0], self.model.score(x)]


def labelled_features(docs: DataFrame, labels: DataFrame, keep: Column, label: str) -> DataFrame:
    """Table of x, y: features of all labelled documents that satisfy keep. Of the texts nothing is shuffled."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.where(keep).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = by_batch(docs.select("doc_id", "text").where(keep), _Kernel(None), "doc_id bigint, x array<double>")
    return written(rows.join(known, "doc_id").select("x", "y"), small=True)


def passes(rows: DataFrame) -> Pass:
    """Passes over a table of x, y by tasks that each send one Part."""
    none = pa.RecordBatch.from_pylist([], pa_schema(ROWS))

    def over(kernel: Callable[[np.ndarray, np.ndarray], Part]) -> Part:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = merged(kernel(*arrays(batch)) for batch in itertools.chain([none], batches))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(own), 1)], "binary")], ["part"])

        return merged(pickle.loads(zlib.decompress(r.part)) for r in rows.coalesce(TASKS).mapInArrow(run, "part binary").collect())

    return over


def arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x, y = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), WIDTH), y.to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", local: int = LOCAL) -> Ranking:
    """Fits on all labelled documents that satisfy keep. The features of up to `local` rows are summed up on the driver, of more by tasks, with the same result."""
    rows = labelled_features(docs, labels, keep, label)
    if rows.count() <= local:
        model = fit(*arrays(rows.toArrow()))
    else:
        model = learnt(passes(rows))
    discard(rows)
    return model


def classify(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, score, predicted: one row per document."""
    scored = by_batch(docs.select("doc_id", "text"), _Kernel(model), "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def filtered(docs: DataFrame, model: Ranking) -> DataFrame:
    """The documents, with all their columns, that classify accepts."""
    return rows_where(docs, lambda texts: (model.score(np.array([features(t) for t in texts]).reshape(len(texts), WIDTH)) >= CUT).tolist())

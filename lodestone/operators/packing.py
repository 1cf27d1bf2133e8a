"""How an index is built: kernels on arrays of numbers, one before and one after the only shuffle.

Before it, the postings of many documents are made at once and packed, by the folder of their terms and the file of their
document, into one row. After it, a task merges the rows of its file and gives the postings sorted by term and document.
Integers travel as little-endian bytes. A task holds the tokens of about LOT_BYTES of text before the shuffle, and of one
file (FILE_BYTES of text in the store) after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import bounded_batches, pa_schema, tidy
from .index import tokenised

#: ids, unnamed (null id), lengths, most (largest tf) and held (postings in the row) are of documents; at (term) and tfs of postings; places of tokens.
PACKED = "part int, terms string, ids binary, unnamed binary, lengths binary, most binary, held binary, at binary, tfs binary, places binary"
POSTINGS = "term string, doc_id bigint, tf bigint, dl bigint, max_tf bigint, positions array<int>, bucket int"
LOT_BYTES, MEMO, OUT_ROWS, OUT_PLACES = 4 << 20, 200_000, 20_000, 200_000


class Terms(dict):
    """Numbers of terms, in the order of their first use; with folders, the folder of each as Spark's xxhash64 gives it."""

    def __init__(self, folders: int = 0):
        self.words, self.folder, self.folders = [], [], folders

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        if self.folders:
            h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
            self.folder.append((h - (1 << 64) if h >> 63 else h) % self.folders)
        return n


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of spans of some sizes, one after another."""
    return np.repeat(first - starts(sizes), sizes) + np.arange(int(sizes.sum()))


def cuts(key: np.ndarray) -> np.ndarray:
    """Where runs of a sorted key begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def sorted_runs(doc: np.ndarray, term: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of one document and term begin in the order by document, term and place, and that order. doc ascends and place within it."""
    n = len(term)
    key = doc * (int(term.max()) + 1 if n else 1) + term
    bits = max(1, n - 1).bit_length()
    if n and int(key.max()).bit_length() + bits < 64:  # the index in the key's low bits: numbers are sorted much faster than an order is found
        key = np.sort(key << bits | np.arange(n))
        order, key = key & ((1 << bits) - 1), key >> bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return cuts(key), order


def pack(ids: list, files: np.ndarray, texts: list[str], known: Terms, of_files: int) -> Iterator[tuple]:
    """Rows of PACKED of documents, whose tokens are joined by spaces."""
    words = [t.split(" ") if t else [] for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    term = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(words)), lengths)
    place = (np.arange(len(term)) - np.repeat(starts(lengths), lengths)).astype(np.int32)
    first, order = sorted_runs(doc, term, place)
    tf, place = np.diff(np.append(first, len(term))), place[order]
    p_term, p_doc = term[order[first]], doc[order[first]]
    p_part = np.array(known.folder, np.int64)[p_term] * of_files + files[p_doc] if len(first) else first
    by_part = np.argsort(p_part.astype(np.uint16) if len(first) and p_part.max() < 1 << 16 else p_part, kind="stable")
    place = place[spans(first[by_part], tf[by_part])]
    p_term, p_doc, p_part, tf = p_term[by_part], p_doc[by_part], p_part[by_part], tf[by_part]
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, p_doc, tf)
    unnamed = np.array([x is None for x in ids], np.uint8)
    named = np.array([x or 0 for x in ids], np.int64)
    edges = np.append(cuts(p_part), len(p_part))
    ends = np.append(starts(tf), len(place))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, at = np.unique(p_term[a:b], return_inverse=True)
        held = np.append(cuts(p_doc[a:b]), b - a)
        of = p_doc[a:b][held[:-1]]
        numbers = (lengths[of], most[of], np.diff(held), at, tf[a:b], place[ends[a] : ends[b]])
        x, y, *rest = (n.astype("<i4").tobytes() for n in numbers)
        yield int(p_part[a]), " ".join(map(known.words.__getitem__, own.tolist())), named[of].astype("<i8").tobytes(), unnamed[of].tobytes(), x, y, *rest


def packed(docs: DataFrame, folders: int, files: int) -> DataFrame:
    """PACKED: part is folder * files + file of a document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = tokenised(docs).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file"), F.array_join("t", " ").alias("t"))
    schema = pa_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lot, size = Terms(folders), [], 0

        def made() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(lot)
            found = list(pack(table["doc_id"].to_pylist(), table["file"].to_numpy().astype(np.int64), table["t"].to_pylist(), known, files))
            for at in range(0, len(found), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 1000], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            lot.append(batch)
            size += batch.nbytes
            if size >= LOT_BYTES:
                yield from made()
                lot, size = [], 0
                if len(known) > MEMO:
                    known = Terms(folders)
        if lot:
            yield from made()
        tidy()

    return rows.mapInArrow(run, PACKED)


class Merged:
    """The packed rows of a part, and then its postings in order."""

    def __init__(self):
        self.known, self.docs = Terms(), 0
        self.columns: list[list[np.ndarray]] = [[] for _ in range(8)]

    def add(self, terms: str, ids: bytes, unnamed: bytes, lengths: bytes, most: bytes, held: bytes, at: bytes, tfs: bytes, places: bytes) -> None:
        words = terms.split(" ")
        number = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        small = lambda x: np.frombuffer(x, "<i4")
        n = len(unnamed)
        doc = np.repeat(np.arange(self.docs, self.docs + n, dtype=np.int32), small(held))
        self.docs += n
        for column, x in zip(self.columns, (np.frombuffer(ids, "<i8"), np.frombuffer(unnamed, np.uint8), small(lengths), small(most), number[small(at)], doc, small(tfs), small(places)), strict=True):
            column.append(x)

    def postings(self, bucket: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids, unnamed, lengths, most, term, doc, tf, places = (np.concatenate(x) for x in self.columns)
        self.columns = []
        words = self.known.words
        by_name = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        rank = np.empty(len(words), np.int64)
        rank[by_name] = np.arange(len(words))
        names = pa.array(words, "string")
        by_id = np.empty(len(ids), np.int64)
        by_id[np.lexsort((ids, unnamed == 0))] = np.arange(len(ids))
        order = np.argsort(rank[term] * len(ids) + by_id[doc])
        first, tf = starts(tf.astype(np.int64))[order], tf[order].astype(np.int64)
        term, doc = term[order], doc[order]
        ends = np.cumsum(tf)
        a = 0
        while a < len(tf):  # a batch is bounded in rows and in places, but holds one row at least
            b = min(a + OUT_ROWS, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + OUT_PLACES, "right"))), len(tf))
            d, n = doc[a:b], tf[a:b]
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, "int32"), pa.array(places[spans(first[a:b], n)], "int32"))
            columns = [names.take(pa.array(term[a:b])), pa.array(ids[d], "int64", mask=unnamed[d] == 1), pa.array(n, "int64"), pa.array(lengths[d], "int64"), pa.array(most[d], "int64"), lists, pa.array(np.full(b - a, bucket, np.int32), "int32")]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            a = b


def unpacked(rows: DataFrame, files: int) -> DataFrame:
    """POSTINGS of packed rows; of each part in a task, sorted by term and document."""
    schema = pa_schema(POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Merged] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(part, Merged()).add(*row)
        for part in sorted(parts):
            yield from parts.pop(part).postings(part // files, schema)
        tidy()

    return rows.mapInArrow(run, POSTINGS)

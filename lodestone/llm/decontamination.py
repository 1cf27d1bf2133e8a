"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of segments. A segment holds the postings of all words of some documents: a dictionary, and
for each of its words the ascending places where it stands (places run on over the segment's documents). Documents are
dealt to segments as they are read, so neither postings nor texts are shuffled, and a hot word or passage is spread over
all segments. Every segment answers every query; a query is a window of a benchmark item.

Phrases: in a segment, a window's posting lists are shifted by their offsets and intersected from the rarest on; a
window with an absent word costs a look-up. Proximity: a window is near where all its words stand in their order, in a
stretch of at most `slack` words more than a window of `width` has (in proportion less for shorter ones): a passage
with words put in. From each place of the rarest word the lists are searched in a band around the offset, then the next
and last places on either side give the smallest stretch. Phrases are near, too.

Benchmark items come in blocks of bounded size, each broadcast and searched in turn, and released if there are several.

Words: A-Z lower-cased, then runs of 0-9, a-z and characters from U+0080. A window is `width` consecutive words of an
item; an item with fewer, but not none, is one window. Null and empty texts have no words and are documents of the
index without postings. Items with equal ids are one; a null id is written as "null". Rows of documents are independent,
repeated rows give a row each; columns besides doc_id, text and item_id are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fit_to_send, pa_schema, slices, tidy, written

WIDTH = 10
#: Words that a near window may hold besides its own.
SLACK = 2
#: Bytes of benchmark text in a block; a block is collected and broadcast.
BLOCK_BYTES = 16 << 20
#: Bytes of text in a segment (more if a document has more), and segments in a file, which a reader holds at once.
SEGMENT_BYTES, FILE_SEGMENTS = 1 << 20, 64
#: A row is large, so the writer looks at the sizes of pages and row groups after each; else a page holds a hundred rows or more, and as much again in the codec's buffers.
PAGES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.block.size": 32 << 20}
#: Windows that are searched at once in a segment.
WINDOWS = 2000
_KEEP = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Queries(NamedTuple):
    """Windows of items as rows of token numbers, -1 after the end. holders: (window, item) pairs sorted by window."""

    vocabulary: dict[str, int]
    windows: np.ndarray
    lengths: np.ndarray
    holders: np.ndarray
    items: list[str]


def compiled(items: list[tuple[str, str]], width: int = WIDTH) -> Queries:
    vocabulary: dict[str, int] = {}
    windows: dict[tuple[int, ...], int] = {}
    names, holders = sorted({i for i, _ in items}), set()
    number = {x: k for k, x in enumerate(names)}
    for item, text in items:
        tokens = [vocabulary.setdefault(w.decode(), len(vocabulary)) for w in words_of(text)]
        for at in range(max(1, len(tokens) - width + 1) if tokens else 0):
            holders.add((windows.setdefault(tuple(tokens[at : at + width]), len(windows)), number[item]))
    table = np.full((len(windows), width), -1, np.int64)
    for window, k in windows.items():
        table[k, : len(window)] = window
    return Queries(vocabulary, table, (table >= 0).sum(1), np.array(sorted(holders), np.int64).reshape(-1, 2), names)


#: The stored index, a row per segment: ids and text hashes of the documents, their first places and the end, the dictionary, postings per word, and all postings in the dictionary's order.
INDEX = "segment bigint, ids array<bigint>, h1 array<bigint>, h2 array<bigint>, starts array<int>, tokens array<string>, counts array<int>, places array<int>"


def index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Builds and stores the index of docs (doc_id, text): INDEX."""
    bounded_batches(docs.sparkSession)
    schema = pa_schema(INDEX)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch, 3, segment_bytes):
                one = lambda x, f: pa.ListArray.from_arrays(pa.array([0, len(x)], "int32"), x if isinstance(x, pa.Array) else pa.array(x, f.type.value_type))
                made = (*part.columns[:3], *inverted(part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([next(number)], "int64"), *(one(x, f) for x, f in zip(made, list(schema)[1:], strict=True))], schema=schema)
        tidy()

    return written(rows.mapInArrow(run, INDEX), maxRecordsPerFile=FILE_SEGMENTS, **PAGES)


def inverted(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(starts, dictionary, counts, places) of a segment."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes, stream = [0], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        stream += map(numbers.__getitem__, words)
    ids = np.array(stream, np.uint16 if len(numbers) <= 1 << 16 else np.int64)
    return np.cumsum(sizes, dtype=np.int64).astype(np.int32), list(numbers), np.bincount(ids, minlength=len(numbers)).astype(np.int32), np.argsort(ids, kind="stable").astype(np.int32)


class Segment:
    """A segment's postings of the words of a vocabulary, numbered as it numbers them."""

    def __init__(self, starts: np.ndarray, tokens: list[str], counts: np.ndarray, places: np.ndarray, vocabulary: dict[str, int]):
        self.starts, self.size = starts.astype(np.int64), int(starts[-1])
        get = vocabulary.get
        known = np.array([get(t, -1) for t in tokens], np.int64)
        ends = np.cumsum(counts, dtype=np.int64)
        held = np.flatnonzero(known >= 0)
        held = held[np.argsort(known[held])]
        self.counts = np.zeros(len(vocabulary), np.int64)
        self.counts[known[held]] = counts[held]
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        n = counts[held].astype(np.int64)
        at = np.repeat(ends[held] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.places = places[at].astype(np.int64)
        self.keys = np.repeat(known[held], n) * (self.size + 1) + self.places

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def after(self, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first posting of each token at or after a place; size if there is none."""
        if not len(self.keys):
            return np.full(len(tokens), self.size)
        at = np.searchsorted(self.keys, tokens * (self.size + 1) + places)
        found = at < self.offsets[tokens + 1]
        return np.where(found, self.places[np.minimum(at, len(self.places) - 1)], self.size)

    def before(self, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The last posting of each token at or before a place; -1 if there is none."""
        if not len(self.keys):
            return np.full(len(tokens), -1)
        at = np.searchsorted(self.keys, tokens * (self.size + 1) + places, "right") - 1
        found = at >= self.offsets[tokens]
        return np.where(found, self.places[np.maximum(at, 0)], -1)

    def rarest_first(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows whose words all occur: (their numbers, their columns from the rarest word on), and of each posting of a rarest word (its window among these, its place)."""
        sizes = np.where(windows >= 0, self.counts[windows], np.iinfo(np.int64).max)
        alive = np.flatnonzero(sizes.min(1) > 0)
        order = np.argsort(sizes[alive], axis=1, kind="stable")
        rarest = windows[alive, order[:, 0]]
        n = self.counts[rarest]
        which = np.repeat(np.arange(len(alive)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return alive, order, which, self.places[self.offsets[rarest][which] + within]

    def phrases(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence inside a document."""
        if not len(windows) or not self.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        alive, order, which, anchor = self.rarest_first(windows)
        start, length = anchor - order[which, 0], lengths[alive]
        inside = (start >= 0) & (start + length[which] <= self.size)
        which, start = which[inside], start[inside]
        same = self.document(start) == self.document(start + length[which] - 1)
        which, start = which[same], start[same]
        for step in range(1, windows.shape[1]):
            column = order[which, step]
            tokens = windows[alive[which], column]
            fits = tokens < 0
            open_ = np.flatnonzero(~fits)
            wanted = start[open_] + column[open_]
            fits[open_] = self.after(tokens[open_], wanted) == wanted
            which, start = which[fits], start[fits]
        return alive[which], start

    def near(self, windows: np.ndarray, lengths: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first place, last place) of the smallest stretch around each posting of a window's rarest word that holds its words in order, at most slack words longer than the window, inside a document."""
        none = np.empty(0, np.int64)
        if not len(windows) or not self.size:
            return none, none, none
        alive, order, which, anchor = self.rarest_first(windows)
        column, length, slack = order[:, 0], lengths[alive], slack[alive]
        for step in range(1, windows.shape[1]):  # a posting of every other word in its band
            other = order[which, step]
            tokens = windows[alive[which], other]
            fits = tokens < 0
            open_ = np.flatnonzero(~fits)
            off = other[open_] - column[which[open_]]
            room = slack[which[open_]]
            low = np.maximum(anchor[open_] + off - np.where(off < 0, room, 0), 0)
            fits[open_] = self.after(tokens[open_], low) <= anchor[open_] + off + np.where(off > 0, room, 0)
            which, anchor = which[fits], anchor[fits]
        first, last = anchor.copy(), anchor.copy()
        for step in range(1, windows.shape[1]):
            right = np.flatnonzero((column[which] + step < length[which]) & (last < self.size))
            last[right] = self.after(windows[alive[which[right]], column[which[right]] + step], last[right] + 1)
            left = np.flatnonzero((column[which] - step >= 0) & (first > 0))
            out = np.flatnonzero((column[which] - step >= 0) & (first <= 0))
            first[out] = -1
            first[left] = self.before(windows[alive[which[left]], column[which[left]] - step], first[left] - 1)
        fits = (first >= 0) & (last < self.size) & (last - first < length[which] + slack[which])
        which, first, last = which[fits], first[fits], last[fits]
        same = self.document(first) == self.document(last)
        return alive[which[same]], first[same], last[same]


def segments(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[tuple[dict[str, object], Segment]]:
    """The stored segments of INDEX, with the raw columns of each."""
    for batch in batches:
        for k in range(batch.num_rows):
            own = {f.name: c[k].values if pa.types.is_list(f.type) else c[k].as_py() for f, c in zip(batch.schema, batch.columns, strict=True)}
            numbers = lambda name: own[name].to_numpy(zero_copy_only=False)  # noqa: B023, E731
            yield own, Segment(numbers("starts"), own["tokens"].to_pylist(), numbers("counts"), numbers("places"), vocabulary)


def items_by_document(segment: Segment, queries: Queries, which: np.ndarray, start: np.ndarray) -> list[list[int]]:
    """For each document the numbers of the items with the windows found at starts."""
    items: list[list[int]] = [[] for _ in range(len(segment.starts) - 1)]
    if len(which):
        first, last = np.searchsorted(queries.holders[:, 0], which), np.searchsorted(queries.holders[:, 0], which, "right")
        n = last - first
        held = queries.holders[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), 1]
        for doc, item in np.unique(np.stack([np.repeat(segment.document(start), n), held], 1), axis=0).tolist():
            items[doc].append(item)
    return items


def spans_by_document(segment: Segment, start: np.ndarray, end: np.ndarray) -> list[list[list[int]]]:
    """For each document the disjoint [start, end) of its hit words, counted in the document."""
    hits: list[list[list[int]]] = [[] for _ in range(len(segment.starts) - 1)]
    docs = segment.document(start)
    base = segment.starts[docs]
    for doc, a, b in zip(docs.tolist(), (start - base).tolist(), (end - base).tolist(), strict=True):
        hits[doc].append([a, b])
    return list(map(joined, hits))


def joined(spans: list[list[int]]) -> list[list[int]]:
    """Sorted disjoint spans with the same union."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


FOUND = "doc_id bigint, n_words bigint, spans array<array<bigint>>, items array<string>, near_spans array<array<bigint>>, near_items array<string>"
KEYED = "segment bigint, place int, h1 bigint, h2 bigint, " + FOUND
_compiled: dict[str, Queries] = {}


class Block(NamedTuple):
    """A block of items under way to the executors."""

    id_: str
    items: object

    def queries(self, width: int) -> Queries:
        if self.id_ not in _compiled:
            _compiled.clear()
            _compiled[self.id_] = compiled(self.items.value, width)
        return _compiled[self.id_]


def blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[tuple[Block, int]]:
    """Broadcasts of about `most` bytes of items at most, by a hash of the id, each with the number of them."""
    spark = items.sparkSession
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where(F.length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = size // most + 1
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Block(uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item_id, r.text) for r in own.collect()])), n


def found_in(segment: Segment, queries: Queries, room: np.ndarray | None) -> tuple:
    """spans, items, near spans and near items of each document. Windows are searched WINDOWS at a time, which bounds the postings in hand; room None: no near windows."""
    exact, near = [], []
    for at in range(0, len(queries.windows), WINDOWS):
        part = slice(at, at + WINDOWS)
        which, start = segment.phrases(queries.windows[part], queries.lengths[part])
        exact.append((which + at, start, start + queries.lengths[part][which]))
        if room is not None:
            which, first, last = segment.near(queries.windows[part], queries.lengths[part], room[part])
            near.append((which + at, first, last + 1))
    out = []
    for parts in (exact, near):
        which, start, end = map(np.concatenate, zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 3
        out += [spans_by_document(segment, start, end), [sorted(queries.items[k] for k in x) for x in items_by_document(segment, queries, which, start)]]
    return tuple(out)


def searched(stored: DataFrame, block: Block, width: int, slack: int | None) -> DataFrame:
    """KEYED: one row per document of the index, with what it has of a block."""
    schema = pa_schema(KEYED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.queries(width)
        room = None if slack is None else slack * queries.lengths // width
        for own, segment in segments(batches, queries.vocabulary):
            n = len(segment.starts) - 1
            columns = [
                [own["segment"]] * n,
                range(n),
                own["h1"],
                own["h2"],
                own["ids"],
                np.diff(segment.starts),
                *found_in(segment, queries, room),
            ]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
        tidy()

    bounded_batches(stored.sparkSession)
    return stored.mapInArrow(run, KEYED)


def search(stored: DataFrame, items: DataFrame, width: int = WIDTH, slack: int | None = SLACK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """FOUND and h1, h2: what each document of a stored index has of the items. Of several blocks, each is searched, its rows with a hit are written, and it is released before the next. slack None: phrases only."""
    bare, parts = None, []
    for block, n in blocks(items, block_bytes):
        found = searched(stored, block, width, slack)
        if n == 1:
            return found.drop("segment", "place")
        parts.append(written(found.where((F.size("near_items") > 0) | (F.size("items") > 0))))
        if bare is None:
            bare = written(found.select("segment", "place", "h1", "h2", "doc_id", "n_words"))
        block.items.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy("segment", "place").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_spans", "near_items")))  # a row a block at most
    spans, names = "array<array<bigint>>", "array<string>"
    merged = {c: united(F.coalesce(F.col(c), F.array().cast(spans))) for c in ("spans", "near_spans")} | {c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast(names)))) for c in ("items", "near_items")}
    return bare.join(hits, ["segment", "place"], "left").withColumns(merged).drop("segment", "place")


def united(spans):
    """joined() as a column."""
    none = F.array().cast("array<array<bigint>>")
    last = lambda done: F.get(done, F.size(done) - 1)
    end = lambda s: F.get(s, F.lit(1))
    meets = lambda done, s: (F.size(done) > 0) & (F.get(s, F.lit(0)) <= end(last(done)))
    grown = lambda done, s: F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(F.get(last(done), F.lit(0)), F.greatest(end(last(done)), end(s)))))
    return F.aggregate(F.array_sort(spans), none, lambda done, s: F.when(meets(done, s), grown(done, s)).otherwise(F.concat(done, F.array(s))))


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Indexes docs and searches the items: one row per document with doc_id, n_words, spans ([start, end) of words in phrases, disjoint), items (ids, sorted as strings), and near_spans, near_items of near windows."""
    return search(index(docs), items, width, slack, block_bytes).drop("h1", "h2")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, spans, items, near_spans, near_items: one row per document."""
    found = find(docs, items, width, slack)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
        "spans",
        "items",
        "near_spans",
        "near_items",
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, with all their columns, in which no window occurs. Rows are told by two hashes of the text, as equal texts have equal verdicts; those to drop are broadcast if few, else joined by a shuffle."""
    found = search(index(docs.select("doc_id", "text")), items, width, None)
    one, two = (f"_h{k}_{uuid.uuid4().hex}" for k in (1, 2))  # no column of docs has these names
    gone = written(found.where(F.size("spans") > 0).select(F.col("h1").alias(one), F.col("h2").alias(two)).distinct())
    return docs.join(fit_to_send(gone), (F.xxhash64("text") == F.col(one)) & (F.xxhash64(F.lit(1), "text") == F.col(two)), "left_anti")

"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers run in series. The first splits a text at the tokenizer's pre-token pattern and at its
special tokens. The second reads a pre-token byte by byte: its state is the last token of the encoding of each prefix
(only the longest token's length of them matters, so states are finitely many), and a transition is annotated with the
tokens that it adds. A token may end at a byte only where merging wouldn't have joined it with the token before, which
the merge table decides; exactly one token qualifies. Whole pre-tokens are memoised, which is the transducer with its
paths flattened.

A text over `chunk` bytes is cut anywhere. A chunk's state map is (head, count, tail): what lies before its first and
after its last safe boundary, where the transducers are in their start state whatever came before. Boundaries are
places before white space, and between characters of two classes (letters, numbers, others) unless an apostrophe or a
special token is at hand. Maps compose associatively: tail and head meet and are counted together. They are combined
by a parallel prefix scan, a tree in which a task composes FAN_IN neighbours, so that no task takes all maps of a
text. A head or tail is as long as a run without a boundary; one pre-token longer than a chunk meets in one task.

Null and empty texts have 0 tokens. Rows are independent, ids may be null or repeat; columns besides doc_id and text
are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, pa_schema

CHUNK = 1 << 16
#: Entries of a worker's memo before it starts anew, and the longest pre-token that it keeps, in characters.
MEMO, LONGEST = 400_000, 40
#: The pre-token pattern of byte-level tokenizers. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: State maps that a task composes; as a string has under 2 ** 31 bytes, so many levels do for any text.
FAN_IN, LEVELS = 32, 3
#: Places where a pre-token ends whatever stands around: before white space, and between letters, numbers and others, but for the apostrophe of a contraction.
BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}'])|(?<=\p{N})(?=[^\s\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for themselves, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}


class ByteTransducer:
    """The second transducer, compiled from a merge table."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        special = {x["content"] for x in spec["added_tokens"]}
        names = {i: t for t, i in model["vocab"].items() if t not in special}
        self.special = sorted(special, key=len, reverse=True)
        order = {x: rank for rank, x in enumerate(t for t in names.values() if len(t) == 1)}
        self.left, self.right, self.joined = list(range(len(order))), list(range(len(order))), {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b not in order:
                order[a + b] = len(self.left)
                self.left.append(order[a])
                self.right.append(order[b])
                self.joined[order[a] << 20 | order[b]] = order[a + b]
        self.ids = {as_bytes(t): i for t, i in order.items()}
        self.longest = max(map(len, self.ids))
        self.adjacent: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b apart when they stand side by side. Tokens are numbered in merge order."""
        left, right, joined = self.left, self.right, self.joined
        limit = len(left)
        while True:
            if joined.get(a << 20 | b, limit) < limit:
                return False
            if a > b:
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True

    def count(self, word: bytes) -> int:
        """Tokens emitted on the path of word."""
        ids, adjacent = self.ids, self.adjacent
        if word in ids:
            return 1
        last, emitted = [-1], [0]
        for i in range(1, len(word) + 1):
            for start in range(max(0, i - self.longest), i):
                token = ids.get(word[start:i])
                if token is None:
                    continue
                before = last[start]
                if before >= 0:
                    pair = before << 20 | token
                    fits = adjacent.get(pair)
                    if fits is None:
                        if len(adjacent) >= MEMO:
                            adjacent.clear()
                        fits = adjacent[pair] = self.may_follow(before, token)
                    if not fits:
                        continue
                last.append(token)
                emitted.append(emitted[start] + 1)
                break
        return emitted[-1]


def stand_ins(path: str) -> dict[int, str]:
    """For characters that this Python's tables and the tokenizer's put in different classes, one of the tokenizer's class.

    Only characters on which the tables of two Unicode versions disagree need a probe of the tokenizer.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    letters, digits, spaces = (set(regex.findall(x, every)) for x in (r"\p{L}", r"\p{N}", r"\s"))
    out = {}
    for c in every:
        kind = "a" if c in letters else "1" if c in digits else "\u2003" if c in spaces else "\ue000"
        older = {"L": "a", "N": "1"}.get(unicodedata.category(c)[0], "\u2003" if c in spaces else "\ue000")
        if kind != older:
            real = next((k for k in ("a", "1", "\ue000") if len(split(k + c)) == 1), "\u2003")
            if real != kind:
                out[ord(c)] = real
    return out


class Counter(dict):
    """Both transducers: counter(text) is the number of tokens. As a dict, the memo of pre-tokens."""

    def __init__(self, path: str):
        super().__init__()
        self.second = ByteTransducer(path)
        self.plain = regex.compile(PATTERN)
        self.stand_ins = stand_ins(path)
        low = min(self.stand_ins, default=0x10FFFF)
        self.late = re.compile(f"[{chr(low)}-\U0010ffff]").search
        self.reach = max(map(len, self.second.special), default=0)
        self.at_special = regex.compile("|".join(map(regex.escape, self.second.special))).split if self.second.special else lambda text: [text]

    def __missing__(self, word: str) -> int:
        n = self.second.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n

    def split(self, text: str) -> list[str]:
        """The first transducer."""
        if self.late(text) and (shown := text.translate(self.stand_ins)) != text:
            return [text[m.start() : m.end()] for m in self.plain.finditer(shown)]
        return self.plain.findall(text)

    def __call__(self, text: str) -> int:
        parts = self.at_special(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(part))) for part in parts)


#: (head, count, tail) with the count of what lies between; (text, None, "") where there is no safe boundary.
StateMap = tuple[str, int | None, str]


def boundaries(text: str, count: Counter) -> tuple[int, int] | None:
    """The first and the last safe boundary inside a text, or None. Near its ends a special token may reach over the cut, so there only white space is one."""
    reach = count.reach
    shown = text.translate(count.stand_ins) if count.late(text) else text

    def safe(at: int) -> bool:
        if shown[at].isspace() or not reach:
            return True
        return reach <= at <= len(text) - reach and not any(text.startswith(x, at - k) for x in count.second.special for k in range(1, len(x)))

    first = next((m.start() for m in BOUNDARY.finditer(shown) if safe(m.start())), None)
    if first is None:
        return None
    size = 1 << 10
    while True:  # the last one is in the last so many characters
        low = max(first, len(text) - size)
        last = max((m.start() for m in BOUNDARY.finditer(shown, max(0, low - 1)) if m.start() >= low and safe(m.start())), default=None)
        if last is not None or low == first:
            return first, first if last is None else last
        size *= 8


def state_map(text: str, count: Counter) -> StateMap:
    found = boundaries(text, count)
    if not found:
        return text, None, ""
    first, last = found
    return text[:first], count(text[first:last]), text[last:]


def composed(a: StateMap, b: StateMap, count: Counter) -> StateMap:
    if a[1] is not None and b[1] is not None:
        return a[0], a[1] + count(a[2] + b[0]) + b[1], b[2]
    if a[1] is None and b[1] is None:
        return state_map(a[0] + b[0], count)
    head, n, tail = state_map((a[0] if a[1] is None else a[2]) + b[0], count)
    if a[1] is None:  # b has boundaries: what the joined part leaves after its last one ends at b's first
        return (head, b[1], b[2]) if n is None else (head, n + count(tail) + b[1], b[2])
    return (a[0], a[1], head) if n is None else (a[0], a[1] + count(head) + n, tail)


def gathered(maps: list[StateMap], count: Counter) -> StateMap:
    """Neighbours composed pairwise; runs without a boundary are joined first, so that a long one is searched once."""
    joined: list[StateMap] = []
    open_: list[str] = []
    for m in [*maps, None]:
        if m is not None and m[1] is None:
            open_.append(m[0])
            continue
        if open_:
            joined.append(state_map("".join(open_), count))
            open_ = []
        if m is not None:
            joined.append(m)
    while len(joined) > 1:
        joined = [composed(*joined[k : k + 2], count) if k + 1 < len(joined) else joined[k] for k in range(0, len(joined), 2)]
    return joined[0]


def total(whole: StateMap, count: Counter) -> int:
    return count(whole[0]) + (whole[1] or 0) + count(whole[2])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The compiled tokenizer of this process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class _Small:
    """Kernel for texts of one chunk. Equal texts that follow one another in a slice are counted once."""

    def __init__(self, path: str):
        self.path = path

    def make(self):
        count = counter(self.path)

        def call(columns: list[pa.Array]) -> list:
            known: dict[str, int] = {}
            out = []
            for text in columns[1].to_pylist():
                n = known.get(text)
                if n is None:
                    n = known[text] = count(text)
                out.append(n)
            return [columns[0], columns[2], out]

        return call


MAPS = "row bigint, doc_id bigint, n_bytes bigint, part bigint, head string, n bigint, tail string"


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row per document. path: a tokenizer file of the tokenizers library with byte-level BPE, readable on every executor."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    small = by_batch(rows.where(F.col("n_bytes") <= chunk), _Small(path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    keyed = rows.where(F.col("n_bytes") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text")
    out_schema = pa_schema("doc_id bigint, n_bytes bigint, n_tokens bigint")
    cut_schema, map_schema = pa_schema("row bigint, doc_id bigint, n_bytes bigint, part bigint, text string"), pa_schema(MAPS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc, size, text = (c[k].as_py() for c in batch.columns)
                for part, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "n_bytes": size, "part": part, "text": text[at : at + chunk]}], schema=cut_schema)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            heads, ns, tails = zip(*(state_map(t, count) for t in batch.column(4).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(heads, "string"), pa.array(ns, "int64"), pa.array(tails, "string")], schema=map_schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by row and part; those of one row and group of FAN_IN parts make one map, numbered as the group."""
        count = counter(path)
        rows = ((*row,) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (row, doc, size, group), own in groupby(rows, key=lambda r: (*r[:3], r[3] // FAN_IN)):
            made = gathered([r[4:] for r in own], count)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row, doc, size, group, *made), map_schema, strict=True)], schema=map_schema)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            ns = [total(m, count) for m in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(ns, "int64")], schema=out_schema)

    chunks = keyed.mapInArrow(cut, "row bigint, doc_id bigint, n_bytes bigint, part bigint, text string").repartition("row", "part")
    mapped = chunks.mapInArrow(maps, MAPS)
    for _ in range(LEVELS):
        mapped = mapped.repartition("row", F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("row", "part").mapInArrow(scan, MAPS)
    giant = mapped.mapInArrow(finished, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return small.unionByName(giant)

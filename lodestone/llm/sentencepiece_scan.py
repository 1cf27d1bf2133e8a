"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model is byte-pair encoding, for which the largest sum of piece scores isn't the library's answer. The scan
therefore runs over the max-plus weights 0 and -infinity: a piece may follow another (0) where the library, given the
two side by side, keeps them apart, else not (-infinity). Exactly one path through a text has weight 0, and it is the
library's encoding: the first merge over a boundary of any other path would show in that pair already.

A text of up to `chunk` characters is one chunk, encoded by the library. A longer one is cut every `chunk` characters.
The states at a cut are the pieces that end at or straddle it. A chunk yields its transfer matrix from entry to exit
states; where it holds a place before white space, over which no piece reaches, all paths meet there and the matrix is
a column plus a row. Matrices of a text are combined associatively, which leaves one state at each cut, and every
chunk is then traced back alone. Only its finite entries are kept of a matrix.

Null and empty texts have no tokens. Rows are independent, ids may be null or repeat; columns besides doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, pa_schema, written

CHUNK = 1 << 15
SPACE = "▁"
State = tuple[int, int]
#: Pairs of pieces whose order a worker remembers.
MEMO = 100_000


class Pieces:
    """A model's pieces and which may follow which."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.vocab_size()
        fixed = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if not fixed[i]}
        self.byte = {int(self.library.id_to_piece(i)[3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that reach over a space are not supported")
        probe = "A  b\u00a0\ufb01 e\u0301\u3000x\n\t\u00c9 "
        if self.library.normalize(probe) != escaped(probe):
            raise ValueError("models that change characters or spaces before encoding are not supported")
        self.raw = [b"" if fixed[i] else self.library.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.memo: dict[tuple[str, str], bool] = {}

    def follows(self, a: str, b: str) -> bool:
        if b[0] == SPACE and a[-1] != SPACE or a not in self.ids or b not in self.ids:
            return True
        known = self.memo.get((a, b))
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            # A line break merges with nothing, so what follows it is encoded as it stands.
            known = self.memo[a, b] = self.library.encode("\n" + (a + b).replace(SPACE, " "), out_type=str)[-2:] == [a, b]
        return known

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text) if text else []

    def tokens(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if i is None else [i]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def escaped(text: str) -> str:
    """As the model sees it: with the dummy prefix, spaces as U+2581."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunk:
    """The part [low, high) of a text, as offsets into `text`, which has `longest` characters of context on either side where the whole text has."""

    def __init__(self, text: str, low: int, high: int, first: bool, last: bool, model: Pieces):
        self.text, self.low, self.high, self.first, self.last, self.model = text, low, high, first, last, model
        meets = [p for p in range(low + 1, high) if text[p] == SPACE and text[p - 1] != SPACE] if high - low < 200 else None
        if meets is None:
            self.head, self.tail = self._meet(range(low + 1, high)), self._meet(range(high - 1, low, -1))
        else:
            self.head, self.tail = (meets[0], meets[-1]) if meets else (None, None)

    def _meet(self, places) -> int | None:
        return next((p for p in places if self.text[p] == SPACE and self.text[p - 1] != SPACE), None)

    def around(self, cut: int) -> list[State]:
        """States at a cut: pieces that end at it or straddle it."""
        n = self.model.longest
        return [(s, e) for s in range(max(0, cut - n), cut) for e in range(cut, min(len(self.text), s + n) + 1) if e > s and (e == s + 1 or self.text[s:e] in self.model.ids)]

    def entries(self) -> list[State]:
        return [(self.low, self.low)] if self.first else self.around(self.low)

    def exits(self) -> list[State]:
        return [(self.high, self.high)] if self.last else self.around(self.high)

    def run(self, starts: list[State], stop: int) -> dict[State, dict[int, State | None]]:
        """Paths of weight 0 from each start until pieces end at or beyond stop: node -> {start number: node before}."""
        text, ids, n, follows = self.text, self.model.ids, self.model.longest, self.model.follows
        nodes: dict[State, dict[int, State | None]] = {}
        by_end: dict[int, list[State]] = {}
        for k, node in enumerate(starts):
            nodes.setdefault(node, {})[k] = None
            if node not in by_end.setdefault(node[1], []):
                by_end[node[1]].append(node)
        for at in range(min(by_end), stop):
            for node in by_end.get(at, ()):
                for end in range(at + 1, min(len(text), at + n) + 1):
                    piece = text[at:end]
                    if end > at + 1 and piece not in ids:
                        continue
                    if node[0] == node[1] or follows(text[node[0] : at], piece):
                        after = (at, end)
                        if after not in nodes:
                            nodes[after] = {}
                            by_end.setdefault(end, []).append(after)
                        for k in nodes[node]:
                            nodes[after].setdefault(k, node)
        return nodes

    def ends(self, nodes: dict[State, dict[int, State | None]], last: bool) -> list[State]:
        """Nodes of a run that are exit states."""
        if last:
            return [x for x in nodes if x[1] == self.high]
        return [x for x in nodes if x[0] < self.high <= x[1]]

    def matrix(self) -> list[tuple[State, State]]:
        """Finite entries (entry, exit), relative to the chunk's low and high cut."""
        starts = self.entries()
        relative = lambda s, cut: (s[0] - cut, s[1] - cut)
        out = lambda x: (0, 0) if self.last else relative(x, self.high)
        if self.head is None:
            nodes = self.run(starts, self.high)
            found = {(k, out(x)) for x in self.ends(nodes, self.last) for k in nodes[x]}
            return sorted((relative(starts[k], self.low), x) for k, x in found)
        nodes = self.run(starts, self.head)
        alive = sorted({k for x in nodes if x[1] == self.head for k in nodes[x]})
        after = self.run([(self.tail, self.tail)], self.high)
        exits = sorted({out(x) for x in self.ends(after, self.last)})
        return [(relative(starts[k], self.low), x) for k in alive for x in exits]

    def traced(self, entry: State, exit_: State) -> list[int]:
        """Tokens of the pieces that start in the chunk, between resolved states (relative to the cuts)."""
        start, stop = (entry[0] + self.low, entry[1] + self.low), (exit_[0] + self.high, exit_[1] + self.high)

        def back(nodes, ends) -> list[int]:
            path = []
            node = ends[0]
            while node is not None:
                path.append(node)
                node = nodes[node][0]
            return [t for s, e in reversed(path) if s >= self.low and e > s for t in self.model.tokens(self.text[s:e])]

        at_end = lambda nodes: [x for x in nodes if (x[1] == self.high if self.last else x == stop)]
        if self.head is None:
            nodes = self.run([start], self.high)
            return back(nodes, at_end(nodes))
        nodes, after = self.run([start], self.head), self.run([(self.tail, self.tail)], self.high)
        # The library adds the space that the middle starts with.
        middle = self.model.encode(self.text[self.head + 1 : self.tail].replace(SPACE, " ")) if self.tail > self.head else []
        return back(nodes, [x for x in nodes if x[1] == self.head]) + middle + back(after, at_end(after))


def product(a: list[tuple[State, State]], b: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """Max-plus product of two transfer matrices, by their finite entries."""
    rows: dict[State, set[State]] = {}
    for s, t in b:
        rows.setdefault(s, set()).add(t)
    return sorted({(s, u) for s, t in a for u in rows.get(t, ())})


def resolved(matrices: list[list[tuple[State, State]]]) -> list[State]:
    """The state at every cut, ends included: where prefix products from the left and from the right both are finite."""
    from itertools import accumulate

    left = list(accumulate(matrices, product))
    right = list(accumulate(reversed(matrices), lambda a, b: product(b, a)))[::-1]
    states = [matrices[0][0][0]]
    for k in range(len(matrices) - 1):
        both = {t for _, t in left[k]} & {s for s, _ in right[k + 1]}
        if len(both) != 1:
            raise ValueError(f"{len(both)} states at cut {k}")
        states.append(both.pop())
    return [*states, matrices[-1][0][1]]


def cuts(text: str, chunk: int, longest: int) -> Iterator[tuple[str, int, int, bool, bool]]:
    """(text with context, low, high, is first, is last) of each chunk of an escaped text."""
    n = max(1, len(text) // chunk)
    for k in range(n):
        low, high = k * chunk, len(text) if k == n - 1 else (k + 1) * chunk
        start = max(0, low - longest)
        yield text[start : high + longest], low - start, high - start, k == 0, k == n - 1


def encode_long(text: str, model: Pieces, chunk: int) -> list[int]:
    """All steps of the scan in one process."""
    parts = [Chunk(*c, model) for c in cuts(escaped(text), chunk, model.longest)]
    states = resolved([p.matrix() for p in parts])
    return [t for p, a, b in zip(parts, states[:-1], states[1:], strict=True) for t in p.traced(a, b)]


class _Encode:
    """Kernel on (doc_id, text) of one chunk: ROUND. Texts go to the library a few at a time, which bounds its ids in memory."""

    def __init__(self, path: str):
        self.path = path

    def make(self):
        model = pieces(self.path)

        def call(columns: list[pa.Array]) -> list:
            tokens, hashes, texts = [], [], columns[1].to_pylist()
            for at in range(0, len(texts), 256):
                found = model.library.encode(texts[at : at + 256], num_threads=1)
                hashes += [sha(model.decode(x)) for x in found]
                tokens.append(pa.array(found, pa.list_(pa.int32())))
            return [columns[0], pa.concat_arrays(tokens), hashes]

        return call


class _Decode:
    """Kernel on (doc_id, tokens): ROUND."""

    def __init__(self, path: str):
        self.path = path

    def make(self):
        model = pieces(self.path)
        return lambda columns: [columns[0], columns[1], [sha(model.decode(x.as_py())) for x in columns[1]]]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


ROUND = "doc_id bigint, tokens array<int>, text_sha256 string"
CUT = "row bigint, doc_id bigint, part int, text string, low int, high int, first boolean, last boolean"


def round_trip(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, tokens (ids), text_sha256 (of the text decoded from them): one row per document. path: a SentencePiece BPE model, readable on every executor."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    small = by_batch(rows.where(F.length("text") < 2 * chunk), _Encode(path), ROUND)
    keyed = rows.where(F.length("text") >= 2 * chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut_schema, state = pa_schema(CUT), "struct<s:int,e:int>"
    matrix_schema = pa_schema(f"row bigint, part int, entries array<struct<a:{state},b:{state}>>")
    states_schema, parts_schema = pa_schema("row bigint, part int, a_s int, a_e int, b_s int, b_e int"), pa_schema("row bigint, doc_id bigint, part int, tokens array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = pieces(path).longest
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc, text = (c[k].as_py() for c in batch.columns)
                for part, c in enumerate(cuts(escaped(text), chunk, longest)):
                    yield pa.RecordBatch.from_pylist([dict(zip(cut_schema.names, (row, doc, part, *c), strict=True))], schema=cut_schema)

    def chunk_of(r: dict) -> Chunk:
        return Chunk(r["text"], r["low"], r["high"], r["first"], r["last"], pieces(path))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"row": r["row"], "part": r["part"], "entries": [{"a": dict(zip("se", a, strict=True)), "b": dict(zip("se", b, strict=True))} for a, b in chunk_of(r).matrix()]} for r in batch.to_pylist()], schema=matrix_schema)

    def resolve(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r["part"])
        found = resolved([[((x["a"]["s"], x["a"]["e"]), (x["b"]["s"], x["b"]["e"])) for x in r["entries"]] for r in own])
        return pa.Table.from_pylist([dict(zip(states_schema.names, (r["row"], r["part"], *a, *b), strict=True)) for r, a, b in zip(own, found[:-1], found[1:], strict=True)], schema=states_schema)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"row": r["row"], "doc_id": r["doc_id"], "part": r["part"], "tokens": chunk_of(r).traced((r["a_s"], r["a_e"]), (r["b_s"], r["b_e"]))} for r in batch.to_pylist()], schema=parts_schema)

    chunks = written(keyed.mapInArrow(cut, CUT).repartition("row", "part"))
    states = chunks.mapInArrow(matrices, f"row bigint, part int, entries array<struct<a:{state},b:{state}>>").groupBy("row").applyInArrow(lambda t: resolve(t), "row bigint, part int, a_s int, a_e int, b_s int, b_e int")
    traced = chunks.join(states, ["row", "part"]).mapInArrow(trace, "row bigint, doc_id bigint, part int, tokens array<int>")
    giant = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    back = by_batch(giant.select("doc_id", "tokens"), _Decode(path), ROUND, "tokens")
    return small.unionByName(back).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), "tokens", "text_sha256")

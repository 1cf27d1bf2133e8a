"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The operator never looks inside it: it
renders successive prefixes of a conversation and compares consecutive outputs. What a turn adds is its piece; what
a turn withdraws from the earlier output is its cut (a template with cuts rewrites history). A probe rendered in
place of the turn's text locates the text inside the piece, which gives the loss mask.

Turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of their own; a null text or
role is empty; rows with a null conv_id form one conversation. Columns besides conv_id, turn, role and text are not read.

A conversation stays in one task, as its digests run over its turns in order, but it is streamed. Of a template with a
true attribute `append_only` a task holds FULL_TURNS turns at most; that declares that a turn adds a piece that depends
on the last WINDOW turns only, and withdraws nothing. Of any other template every prefix is rendered in full, so a task
holds the conversation, in time that grows with the square of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Stands in for a text when a turn's text is located; drawn longer while it occurs in the conversation.
PROBE = "\ue000\ue001"
#: Up to so many turns every prefix is rendered in full; beyond, for a template declared append-only, over a window, once windows have agreed with prefixes.
FULL_TURNS = 64
WINDOW = 8

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_HEAD = re.compile(r"### ((?:[^:\\]|\\.)*): ", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def marked_turns(turns: list[Turn]) -> str:
    """The template of the query: '### Role: text</turn>' per turn, control strings in roles and texts escaped."""
    return "".join("### {}: {}</turn>\n".format(escape(role).replace(":", "\\:"), escape(text)) for role, text in turns)


marked_turns.append_only = True


def pieces(turns: Iterator[Turn], template: Template, window: int = WINDOW, full_turns: int = FULL_TURNS) -> Iterator[tuple[int, str, int, int, int]]:
    """For each turn: (chars of earlier output withdrawn, text added, start and end of the turn's text in it, chars of output so far).

    Prefixes start at the first turn. Beyond full_turns turns, those of a template declared append_only start `window`
    turns back, if windows gave what full prefixes did for all earlier turns.
    """
    held: list[Turn] = []
    past, total, local = "", 0, bool(getattr(template, "append_only", False))
    for k, turn in enumerate(turns):
        held.append(turn)
        if local and k >= full_turns:
            del held[: len(held) - window]
            past = template(held[:-1])
        now = template(held)
        cut, new = added(past, now)
        if local and window <= k < full_turns:
            near = held[-window:]
            local = added(template(near[:-1]), template(near)) == (cut, new)
        total += len(new) - cut
        yield (cut, new, *located(held, now, len(now) - len(new), template), total)
        past = now


def added(past: str, now: str) -> tuple[int, str]:
    """(chars of past withdrawn, what now has beyond the common start)."""
    if now.startswith(past):
        return 0, now[len(past) :]
    low, high = 0, min(len(past), len(now))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if past[:mid] == now[:mid] else (low, mid - 1)
    return len(past) - low, now[low:]


def located(held: list[Turn], now: str, base: int, template: Template) -> tuple[int, int]:
    """Where the last turn's text stands in the piece that starts at base: (0, 0) if the template doesn't print it."""
    role, text = held[-1]
    probe = PROBE
    while probe in now:
        probe += PROBE
    shown = template([*held[:-1], (role, probe)])
    at = shown.rfind(probe)
    tail = len(shown) - at - len(probe)
    if at < base or now[:at] != shown[:at] or at + tail > len(now) or shown[at + len(probe) :] != now[len(now) - tail :]:
        return 0, 0
    return at - base, len(now) - tail - base


PIECES = "conv_id bigint, position bigint, role string, cut bigint, piece string, text_start bigint, text_end bigint, in_loss boolean, formatted_chars bigint"


def format_conversations(turns: DataFrame, template: Template = marked_turns, learn: tuple[str, ...] = ("assistant",), window: int = WINDOW) -> DataFrame:
    """One row per turn, in order within a conversation and partition: the piece it adds, the place of its text, and whether that is under the loss mask."""
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    schema = pa_schema(PIECES)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows of PIECES. The turns of a conversation are pulled as its pieces are made."""
        rows = ((*row,) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        head = next(rows, None)
        while head is not None:
            conv = head[0]

            def own() -> Iterator[Turn]:
                nonlocal head
                while head is not None and head[0] == conv:  # noqa: B023
                    now, head = head, None
                    roles.append(now[1])
                    yield now[1:]
                    if head is None:
                        head = next(rows, None)

            roles: list[str] = []
            for position, (cut, new, start, end, total) in enumerate(pieces(own(), template, window)):
                role = roles.pop()
                yield conv, position, role, cut, new, start, end, role in learn, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(conversations(batches), schema)

    return ordered.mapInArrow(run, PIECES)


def gathered(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= most or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_back(output: str) -> list[Turn]:
    """The turns of an output of marked_turns."""
    found, at = [], 0
    while at < len(output):
        head = _HEAD.match(output, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        end = head.end()
        while True:
            end = output.index("</turn>\n", end)
            slashes = end
            while output[slashes - 1] == "\\" and slashes > head.end():
                slashes -= 1
            if (end - slashes) % 2 == 0:
                break
            end += 1
        found.append((unescape(head[1]), unescape(output[head.end() : end])))
        at = end + len("</turn>\n")
    return found


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_rewrites bigint"


def digests(formatted: DataFrame, parse: Callable[[str], list[Turn]] = read_back) -> DataFrame:
    """Per conversation, what the formatted pieces say when read back. formatted: as format_conversations left it, in order and in the same partitions."""
    schema = pa_schema(DIGEST)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, state = None, None
        for batch in batches:
            columns = {f.name: c.to_pylist() for f, c in zip(batch.schema, batch.columns, strict=True)}
            for k in range(batch.num_rows):
                if state is None or columns["position"][k] == 0:
                    if state is not None:
                        yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]
                    conv, state = columns["conv_id"][k], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                piece = columns["piece"][k]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if columns["in_loss"][k]:
                    learnt = unescape(piece[columns["text_start"][k] : columns["text_end"][k]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] = columns["formatted_chars"][k]
                state[5] += columns["cut"][k] > 0
        if state is not None:
            yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]

    return formatted.select("conv_id", "position", "cut", "piece", "text_start", "text_end", "in_loss", "formatted_chars").mapInArrow(lambda b: gathered(rows(b), schema), DIGEST)

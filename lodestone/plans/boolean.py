"""The boolean query language: a query string becomes a tree, the tree a DataFrame (doc_id, positions).

Operators are upper case and tried in a fixed order, each splitting the whole string: AND NOT (every occurrence), OR NOT
and then AND, OR (first occurrence), leading NOT, #n(a, b), quotes, else all words of the string. So OR binds tighter
than AND. Strings and their parts are stripped first. Empty queries and phrases with unknown words give no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenise
from ..operators.index import postings, shift


class Terms(NamedTuple):
    words: tuple[str, ...]


class Phrase(NamedTuple):
    words: tuple[str, ...]


class Near(NamedTuple):
    words: tuple[str, ...]
    within: int


class Not(NamedTuple):
    words: tuple[str, ...]


class Both(NamedTuple):
    left: object
    right: object


class Either(NamedTuple):
    left: object
    right: object


class Without(NamedTuple):
    left: object
    right: tuple


class OrNot(NamedTuple):
    left: object
    right: object


def parse(query: str):
    query = query.strip()
    if " AND NOT " in query:
        first, *rest = query.split(" AND NOT ")
        return Without(parse(first), tuple(map(parse, rest)))
    if " OR NOT " in query:
        left, right = query.split(" OR ", 1)
        return Either(parse(left), parse(right))
    for mark, node in ((" AND ", Both), (" OR ", Either)):
        if mark in query:
            left, right = query.split(mark, 1)
            return node(parse(left), parse(right))
    if query.startswith("NOT "):
        return Not(tuple(tokenise(query.replace("NOT ", " "))))
    if query.startswith("#"):
        found = re.fullmatch(r"#(\d+)\s*\((.*)\)\s*", query, re.S)
        if not found:
            raise ValueError(f"malformed proximity query: {query!r}")
        return Near(tuple(tokenise(found[2])), int(found[1]))
    if '"' in query:
        return Phrase(tuple(tokenise(query.replace('"', ""))))
    return Terms(tuple(tokenise(query)))


def words_of(tree) -> set[str]:
    if isinstance(tree, (Terms, Phrase, Near, Not)):
        return set(tree.words)
    right = tree.right if isinstance(tree, Without) else (tree.right,)
    return words_of(tree.left).union(*map(words_of, right))


def evaluate(query: str, docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, positions). One pass over docs (or a read of an index) finds all words of the query, grouped by document; the tree is then an expression over that row, so no leaf is joined. docs may hold ids only if there is an index."""
    tree = parse(query)
    words = sorted(words_of(tree))
    if not words:
        matched, positions = compiled(tree, {})
        return docs.where(matched).select("doc_id", positions.alias("positions"))
    hits = (postings(docs, words) if index is None else index.where(F.col("term").isin(words))).groupBy("doc_id").agg(*(F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))).alias(f"w{k}") for k, w in enumerate(words)))
    columns = {w: F.coalesce(F.col(f"w{k}"), F.array().cast("array<int>")) for k, w in enumerate(words)}
    rows = docs.select("doc_id").join(hits, "doc_id", "left") if needs_absent(tree) else hits
    matched, positions = compiled(tree, columns)
    return rows.where(matched).select("doc_id", positions.alias("positions"))


def stored(query: str, store) -> DataFrame:
    """evaluate() over a stored index: reads the postings of the query's words, and all ids only if documents without any of them can match."""
    return evaluate(query, store.documents(), store.postings(sorted(words_of(parse(query)))))


def needs_absent(tree) -> bool:
    """Whether documents without any word of the query can match."""
    if isinstance(tree, Not):
        return True
    if isinstance(tree, Without):
        return needs_absent(tree.left)
    if isinstance(tree, Both):
        return needs_absent(tree.left) and needs_absent(tree.right)
    return isinstance(tree, Either) and (needs_absent(tree.left) or needs_absent(tree.right))


def compiled(tree, columns):
    """(condition, positions) as expressions over one position array per word."""
    none = F.array().cast("array<int>")
    if isinstance(tree, Without):
        matched, positions = compiled(tree.left, columns)
        for part in tree.right:
            matched &= ~compiled(part, columns)[0]
        return matched, positions
    if isinstance(tree, (Both, Either)):
        (a, p), (b, q) = compiled(tree.left, columns), compiled(tree.right, columns)
        return (a & b if isinstance(tree, Both) else a | b), F.concat(F.when(a, p).otherwise(none), F.when(b, q).otherwise(none))
    if not tree.words:
        return F.lit(isinstance(tree, Not)), none
    own = [columns[w] for w in tree.words]
    if isinstance(tree, Not):
        condition = F.lit(True)
        for c in own:
            condition &= F.size(c) == 0
        return condition, none
    if isinstance(tree, Terms):
        condition = F.lit(True)
        for c in own:
            condition &= F.size(c) > 0
        return condition, own[0] if len(own) == 1 else F.array_sort(F.array_distinct(F.concat(*own)))
    if isinstance(tree, Phrase):
        starts = own[0]
        for i, c in enumerate(own[1:], 1):
            starts = F.array_intersect(starts, shift(c, i))
        return F.size(starts) > 0, F.array_sort(starts)
    starts = F.array_sort(F.array_distinct(F.concat(*own)))
    for c in own:
        starts = F.filter(starts, reaches(c, tree.within))
    return F.size(starts) > 0, starts


def reaches(positions, within: int):
    """Whether one of positions lies in [p, p + within], as a function of p."""
    return lambda p: F.exists(positions, lambda x: x.between(p, p + within))

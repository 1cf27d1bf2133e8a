"""The positional inverted index as DataFrames, and posting lists as sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stems, tokens, without
from ..plans.storage import bounded_batches


def tokenised(docs: DataFrame, stop_words: list[str] | None = None, stem: bool = False, keep: str = "") -> DataFrame:
    """(doc_id, t): tokens of headline and text. Positions count before stop words go, so t keeps them; see postings."""
    whole = F.concat_ws(" ", "headline", "text") if "headline" in docs.columns else F.col("text")
    found = tokens(whole, keep)
    if stop_words is not None:
        found = without(found, stop_words)
    if stem:
        bounded_batches(docs.sparkSession)
    return docs.select("doc_id", (stems(found) if stem else found).alias("t"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def changes(s: Column, field: str) -> Column:
    """Where, in an array of structs that isn't empty, a run of equal fields begins."""
    return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)[field] != F.get(s, i - 1)[field]))


def run(s: Column, firsts: Column, first: Column, k: Column) -> Column:
    """The part of s from the k-th of its runs' beginnings to the next."""
    return F.slice(s, first + 1, F.coalesce(F.get(firsts, k + 1), F.size(s)) - first)


def runs(s: Column, field: str, made) -> Column:
    """made(run) of every run of equal fields; null if s is empty."""
    return F.when(F.size(s) > 0, let(changes(s, field), lambda fs: F.transform(fs, lambda f, k: made(run(s, fs, f, k)))))


def grouped(placed: Column) -> Column:
    """array<struct<term, positions>> of an array<struct<term, pos>>: sorted, so that a term's places are neighbours, and cut where the term changes."""
    return let(F.sort_array(placed), lambda s: runs(s, "term", lambda own: F.struct(F.get(own, F.lit(0))["term"].alias("term"), F.transform(own, lambda x: x["pos"]).alias("positions"))))


def packed(docs: DataFrame, folder) -> DataFrame:
    """(doc_id, dl, bucket, terms, starts, places): a document's postings of a folder in one row, to be shuffled.

    terms are joined by a space, which no token holds; the k-th has the places from starts[k] on, up to the next start.
    """
    placed = F.transform(F.col("t"), lambda x, i: F.struct(folder(x).alias("bucket"), x.alias("term"), i.alias("pos")))
    parts = let(F.sort_array(placed), lambda s: runs(s, "bucket", lambda own: own))
    rows = tokenised(docs).select("doc_id", F.size("t").alias("dl"), F.explode(parts).alias("s")).select("doc_id", "dl", "s", changes(F.col("s"), "term").alias("starts"))
    terms = F.array_join(F.transform("starts", lambda f: F.get("s", f)["term"]), " ")
    return rows.select("doc_id", "dl", F.get("s", F.lit(0))["bucket"].alias("bucket"), terms.alias("terms"), "starts", F.transform("s", lambda x: x["pos"]).alias("places"))


def unpacked(rows: DataFrame) -> DataFrame:
    """(bucket, term, doc_id, tf, dl, positions) of packed rows."""
    posting = lambda ts, f, k: F.struct(F.get(ts, k).alias("term"), run(F.col("places"), F.col("starts"), f, k).alias("positions"))
    every = rows.select("bucket", "doc_id", "dl", F.explode(let(F.split("terms", " "), lambda ts: F.transform("starts", lambda f, k: posting(ts, f, k)))).alias("p"))
    return every.select("bucket", "p.term", "doc_id", F.size("p.positions").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"), "p.positions")


def postings(docs: DataFrame, terms: list[str] | None = None, stop_words: list[str] | None = None, stem: bool = False) -> DataFrame:
    """(term, doc_id, tf, positions): one row per term and row of docs, whose ids are unique. With terms, other tokens are dropped inside the array.

    A document's tokens are grouped inside its row, so there is no shuffle, and no row for an occurrence.
    """
    placed = F.transform(F.col("t"), lambda x, i: F.struct(x.alias("term"), i.alias("pos")))
    if terms is not None:
        placed = F.filter(placed, lambda p: p["term"].isin(terms))
    if stop_words:
        placed = F.filter(placed, lambda p: ~p["term"].isin(stop_words))
    rows = tokenised(docs, stem=stem).select("doc_id", F.explode(grouped(placed)).alias("p"))
    return rows.select("p.term", "doc_id", F.size("p.positions").cast("bigint").alias("tf"), "p.positions")


def lexicon(index: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, dl): tokens per document; no shuffle."""
    return tokenised(docs).select("doc_id", F.size("t").cast("bigint").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n, lbar): documents, and tokens per document on average."""
    return doc_stats(docs).agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("lbar"))


def headline_index(docs: DataFrame) -> DataFrame:
    """(headline, doc_id, span): tokens of a headline, the last document with it, and the positions that they take there."""
    found = docs.select("doc_id", tokens(F.col("headline")).alias("h")).where(F.size("h") > 0)
    last = found.groupBy(F.concat_ws(" ", "h").alias("headline")).agg(F.max("doc_id").alias("doc_id"), F.max(F.size("h")).alias("k"))
    return last.select("headline", "doc_id", F.sequence(F.lit(0), F.col("k") - 1).alias("span"))


def insert(positions: Column, new: Column) -> Column:
    return F.array_sort(F.array_union(positions, F.array(new)))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def shift(a: Column, by: int) -> Column:
    return F.transform(a, lambda x: x - by)


def shown(a: Column) -> Column:
    return F.concat_ws(" --> ", a.cast("array<string>"))


def trie_words(inserts: DataFrame) -> DataFrame:
    """(word, index_id, word_frequency) of inserts (word, index_id, seq): every insert counts, the last index_id holds."""
    return inserts.groupBy("word").agg(F.max_by("index_id", "seq").alias("index_id"), F.count("*").alias("word_frequency"))


def with_prefix(words: DataFrame, prefix: str, column: str = "word") -> DataFrame:
    """Pushed to the scan as StringStartsWith where words are a stored table, as the lexicon is."""
    return words.where(F.col(column).startswith(prefix))


def trie_search(words: DataFrame, word: str) -> DataFrame:
    """The row of a word, as trie_words made it; none if it isn't in the trie."""
    return words.where(F.col("word") == word)


def trie_contains(words: DataFrame, word: str) -> bool:
    return not trie_search(words, word).isEmpty()


def trie_len(words: DataFrame) -> DataFrame:
    """One row (size): the number of inserts."""
    return words.agg(F.coalesce(F.sum("word_frequency"), F.lit(0)).alias("size"))


def trie_traverse(words: DataFrame) -> DataFrame:
    """The words in depth-first order, children by character: a word comes before those that it starts."""
    return words.orderBy("word")

"""Ranking over a stored index: TF-IDF sums, vector-space cosine with tf and idf modes, BM25 cells, relevance feedback.

A query reads the postings of its own words; lexicon rows of those words and corpus constants are broadcast. Norms of
documents are stored for every mode. Cosine ranks every document: one without a query word scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenise
from .index import postings

BM25_K = 1.5
TF_MODES, IDF_MODES = ("n", "l", "a"), ("n", "t", "p")


def norm_name(mode: str, tf_mode: str = "l", idf_mode: str = "t") -> str:
    """The column of doc_stats with a mode's norms."""
    return "norm_bm25" if mode == "bm25" else f"norm_{tf_mode}{idf_mode}"


def tf_weight(mode: str, tf: Column, max_tf: Column | None = None) -> Column:
    """n: tf; l: 1 + log10 tf; a: 0.5 + 0.5 tf / max_tf. A tf of 0 weighs 0."""
    made = {"n": tf.cast("double"), "l": 1 + F.log10(tf)}.get(mode)
    if made is None:
        made = 0.5 + 0.5 * tf / max_tf
    return F.when(tf == 0, 0.0).otherwise(made)


def idf_weight(mode: str, df: Column, n: Column) -> Column:
    """n: 1; t: log10(N/df); p: max(0, log10((N-df)/df)), 0 if df = N; bm25: log10((N-df+.5)/(df+.5)), which may be negative."""
    return {
        "n": F.lit(1.0),
        "t": F.log10(n / df),
        "p": F.when(df >= n, 0.0).otherwise(F.greatest(F.lit(0.0), F.log10((n - df) / df))),
        "bm25": F.log10((n - df + 0.5) / (df + 0.5)),
    }[mode]


def bm25_cell(tf: Column, length: Column, lbar: Column, idf: Column, k: float = BM25_K) -> Column:
    return tf / (k * (length / lbar) + tf + 0.5) * idf


def query_terms(store, query: str) -> DataFrame:
    """(term, qtf, df, n, lbar) of the words of a query that the lexicon has: a few rows, to broadcast."""
    counts: dict[str, int] = {}
    for w in tokenise(query):
        counts[w] = counts.get(w, 0) + 1
    terms = store.spark.createDataFrame(sorted(counts.items()), "term string, qtf bigint")
    return store.lexicon(sorted(counts)).join(F.broadcast(terms), "term").crossJoin(F.broadcast(store.corpus_stats())).select("term", "qtf", "df", "n", "lbar")


def cells(store, query: str) -> DataFrame:
    """(doc_id, term, tf, dl, qtf, df, n, lbar) for the words of a query."""
    return store.postings(sorted(set(tokenise(query)))).drop("positions").join(F.broadcast(query_terms(store, query)), "term")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best by rounded score, then id."""
    return scored.select("doc_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def tfidf(store, query: str) -> DataFrame:
    """Sum over query words, repeats counting, of (1 + log10 tf) log10(N/df)."""
    return cells(store, query).groupBy("doc_id").agg(F.sum(F.col("qtf") * (1 + F.log10("tf")) * F.log10(F.col("n") / F.col("df"))).alias("score"))


def bm25(store, query: str, k: float = BM25_K) -> DataFrame:
    """Sum over distinct query words of their BM25 cells."""
    cell = bm25_cell(F.col("tf"), F.col("dl"), F.col("lbar"), idf_weight("bm25", F.col("df"), F.col("n")), k)
    return cells(store, query).groupBy("doc_id").agg(F.sum(cell).alias("score"))


def weighted(rows: DataFrame, mode: str = "tfidf", tf_mode: str = "l", idf_mode: str = "t") -> DataFrame:
    """Adds w, the vector-space weight, to rows with tf, df, n and what the mode needs of dl, lbar and max_tf."""
    if mode == "bm25":
        return rows.withColumn("w", bm25_cell(F.col("tf"), F.col("dl"), F.col("lbar"), idf_weight("bm25", F.col("df"), F.col("n"))))
    return rows.withColumn("w", tf_weight(tf_mode, F.col("tf"), F.col("max_tf") if tf_mode == "a" else None) * idf_weight(idf_mode, F.col("df"), F.col("n")))


def query_vector(store, query: str, mode: str = "tfidf", tf_mode: str = "l", idf_mode: str = "t") -> DataFrame:
    """(term, qw) for the words of the query in the vocabulary. In bm25 mode the query's length ratio is 1."""
    words = tokenise(query)
    as_document = query_terms(store, query).withColumns({"tf": F.col("qtf"), "dl": F.col("lbar"), "max_tf": F.lit(max([1, *map(words.count, words)]))})
    return weighted(as_document, mode, tf_mode, idf_mode).select("term", F.col("w").alias("qw"))


def cosine(store, vector: DataFrame, mode: str = "tfidf", tf_mode: str = "l", idf_mode: str = "t") -> DataFrame:
    """(doc_id, score): cosine of every document with (term, qw), the vector of a query or an expanded one; 0 where a norm is 0. Reads the postings of the vector's terms only."""
    terms = vector.join(store.lexicon(), "term").crossJoin(F.broadcast(store.corpus_stats()))
    found = store.postings().drop("positions").join(F.broadcast(terms), "term")
    return scored(store, found, vector, mode, tf_mode, idf_mode)


def scored(store, found: DataFrame, vector: DataFrame, mode: str, tf_mode: str, idf_mode: str) -> DataFrame:
    """The cosines, from the postings found with qw, df, n, lbar."""
    dots = weighted(found, mode, tf_mode, idf_mode).groupBy("doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    size = F.col("norm") * F.col("qn")
    qn = vector.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    every = store.doc_stats().select("doc_id", F.col(norm_name(mode, tf_mode, idf_mode)).alias("norm")).join(dots, "doc_id", "left").crossJoin(F.broadcast(qn))
    return every.select("doc_id", F.when(F.coalesce(size, F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dot", F.lit(0.0)) / size).alias("score"))


def vsm(store, query: str, mode: str = "tfidf", tf_mode: str = "l", idf_mode: str = "t") -> DataFrame:
    """(doc_id, score) of every document for a query string."""
    vector = query_vector(store, query, mode, tf_mode, idf_mode)
    return scored(store, cells(store, query).join(F.broadcast(vector), "term"), vector, mode, tf_mode, idf_mode)


def feedback(store, docs: DataFrame, query: str, first: int = 5, last: int = 1, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.0) -> DataFrame:
    """(term, weight): alpha q + beta centroid(first documents) + gamma centroid(last documents), gamma added. Centroids divide by the number of documents taken.

    The ids of those few documents are collected, so that only their texts are read and tokenised.
    """
    vector = query_vector(store, query)
    ranked = vsm(store, query).select("doc_id", F.round("score", 4).alias("score"))
    parts = [vector.select("term", (alpha * F.col("qw")).alias("weight"))]
    for share, k, order in ((beta, first, (F.desc("score"), F.col("doc_id"))), (gamma, last, (F.col("score"), F.desc("doc_id")))):
        ids = [r.doc_id for r in ranked.orderBy(*order).limit(k).collect()] if share else []
        if ids:
            own = postings(docs.where(F.col("doc_id").isin(ids)))
            full = store.lexicon().join(F.broadcast(own.select("term", "doc_id", "tf")), "term").crossJoin(F.broadcast(store.corpus_stats()))
            parts.append(weighted(full).select("term", (F.col("w") * share / len(ids)).alias("weight")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("term").agg(F.sum("weight").alias("weight"))


def top_terms(vectors: DataFrame, t: int = 5, by: str | None = None) -> DataFrame:
    """The t heaviest terms of a vector (term, weight), or of each of several told by a column; of equals the first by name. Ranks are limited inside each task before the shuffle."""
    order = (F.desc(F.round("weight", 9)), F.col("term"))
    if by is None:
        return vectors.orderBy(*order).limit(t)
    return vectors.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= t).drop("_r")


def vectors(store, mode: str = "tfidf", tf_mode: str = "l", idf_mode: str = "t") -> DataFrame:
    """(doc_id, term, weight): the whole score matrix. Only for what needs every cell; ranking doesn't."""
    from .store import with_df  # which imports this module

    full = with_df(store.postings().drop("positions"), store.lexicon().select("term", "df"), named=True).crossJoin(F.broadcast(store.corpus_stats()))
    return weighted(full, mode, tf_mode, idf_mode).select("doc_id", "term", F.col("w").alias("weight"))

"""The stored index: built once, read by every query.

A store is a folder of epochs. An epoch holds the versions (doc_id, digest) and the postings of the documents that it
brought. Postings lie in folders by a hash of the term, as many as the bytes of text call for, and in several files of a
folder by a hash of the document, each sorted by term: a query reads the folders of its terms and there, by the footers'
statistics, their row groups, and a frequent term is spread over the files. Building shuffles postings once, packed to one row
of many documents and a file (packing.py). A posting has its document's length and largest tf. Versions are written last, so an epoch with versions is whole; writing an epoch again replaces it. Of a document the last epoch counts: postings of
earlier ones are left out of every read. `refresh` makes the statistics of the documents that count: lexicon, lengths,
norms of the vector space in every mode, corpus constants.

Documents without tokens are counted and have norms of 0. A null text or headline is empty. Of rows with one id in an
epoch one counts. An empty corpus can be stored; it has no terms, and n is 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import children, epochs, exists, remove, scratch, shuffles_removed, unsorted_folders
from .packing import packed, unpacked
from .rank import BM25_K, IDF_MODES, bm25_cell, idf_weight, norm_name

POSTINGS = "term string, doc_id bigint, tf bigint, dl bigint, max_tf bigint, positions array<int>"
#: Bytes of text whose postings share a folder, and a file: what a task sorts without spilling in 400 MB.
FOLDER_BYTES, FILE_BYTES, MOST_FOLDERS = 1 << 30, 16 << 20, 4096
#: Bytes of the lexicon, its most frequent terms, that are broadcast at most.
SENT_BYTES = 16 << 20


class Store(NamedTuple):
    spark: SparkSession
    path: str
    at: tuple[int, ...]

    @property
    def stats(self) -> str:
        return f"{self.path}/stats/epoch={self.at[-1]}"

    def versions(self) -> DataFrame:
        """(doc_id, digest, epoch) of the documents that count."""
        every = read_epochs(self, "versions", "doc_id bigint, digest string")
        return every if len(self.at) == 1 else every.groupBy("doc_id").agg(F.max_by("digest", "epoch").alias("digest"), F.max("epoch").alias("epoch"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """POSTINGS, of some terms or of all."""
        every = []
        for k in self.at:
            at = f"{self.path}/postings/epoch={k}"
            of = int(children(self.spark, at, "of=")[-1])
            rows = self.spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{at}/of={of}")
            if terms is not None:
                rows = rows.where(F.col("bucket").isin([bucket(F.lit(t), of) for t in terms]) & F.col("term").isin(terms)) if terms else rows.where("false")
            every.append(rows.drop("bucket").withColumn("epoch", F.lit(k).cast("bigint")))
        rows = union(every)
        if len(self.at) > 1:
            rows = rows.join(self.versions().select("doc_id", "epoch"), ["doc_id", "epoch"], "left_semi")
        return rows.select("term", "doc_id", "tf", "dl", "max_tf", "positions")

    def lexicon(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df, cf), sorted by term in its files."""
        found = self.spark.read.parquet(f"{self.stats}/lexicon")
        return found if terms is None else found.where(F.col("term").isin(terms))

    def doc_stats(self) -> DataFrame:
        """(doc_id, dl, max_tf, and a norm for every mode)."""
        return self.spark.read.parquet(f"{self.stats}/doc_stats")

    def corpus_stats(self) -> DataFrame:
        """One row: n, lbar."""
        return self.spark.read.parquet(f"{self.stats}/corpus_stats")

    def documents(self) -> DataFrame:
        return self.doc_stats().select("doc_id")


def read_epochs(store: Store, name: str, schema: str) -> DataFrame:
    every = [store.spark.read.schema(schema).parquet(f"{store.path}/{name}/epoch={k}").withColumn("epoch", F.lit(k).cast("bigint")) for k in store.at]
    return union(every)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bucket(term: Column, of: int) -> Column:
    """The folder of a term."""
    return F.pmod(F.xxhash64(term), F.lit(of)).cast("int")


def digest(docs: DataFrame) -> Column:
    """What tells one version of a document from another: all its columns but the id."""
    return F.sha2(F.to_json(F.struct(*(c for c in sorted(docs.columns) if c != "doc_id")), {"ignoreNullFields": "false"}).cast("binary"), 256)


def write_epoch(docs: DataFrame, path: str, epoch: int) -> None:
    """Versions and postings of docs (doc_id, text; optional headline and more), in place of what the epoch held."""
    spark = docs.sparkSession
    rows = docs.select("*", digest(docs).alias("digest"))
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # reads ids only; texts are shuffled where ids repeat
        rows = rows.dropDuplicates(["doc_id"])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    of = min(MOST_FOLDERS, 1 << max(0, (size // FOLDER_BYTES).bit_length()))
    files = max(spark.sparkContext.defaultParallelism, size // of // FILE_BYTES + 1)
    remove(spark, f"{path}/versions/epoch={epoch}")
    remove(spark, f"{path}/postings/epoch={epoch}")
    dealt = packed(rows, of, files).repartitionById(of * files, F.col("part"))
    with shuffles_removed(spark), unsorted_folders(spark):
        unpacked(dealt, files).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/epoch={epoch}/of={of}")
    rows.select("doc_id", "digest").write.mode("overwrite").parquet(f"{path}/versions/epoch={epoch}")


def with_df(rows: DataFrame, lexicon: DataFrame, named: bool = False) -> DataFrame:
    """rows (term, doc_id, tf, dl) with df. named: and with their terms, the rare ones where the shuffle by term left them.

    Most postings are of frequent terms. As many of these as SENT_BYTES hold are broadcast, so their postings stay where
    they are; postings of the rest, of which no term is hot, are shuffled by term and, before they are summed, by document.
    """
    size = F.octet_length("term") + 16
    steps = [1 << s for s in range(48)]
    held = lexicon.agg(*(F.sum(F.when(F.col("df") >= s, size)).alias(f"s{s}") for s in steps)).first()
    least = next((s for s in steps if (held[f"s{s}"] or 0) <= SENT_BYTES), steps[-1])
    frequent = F.broadcast(lexicon.where(F.col("df") >= least))
    known = rows.join(frequent, "term")
    if least > 1:
        rare = rows.join(frequent, "term", "left_anti").join(lexicon.where(F.col("df") < least), "term")
        known = known.unionByName(rare if named else rare.repartition("doc_id"))
    return known if named else known.drop("term")


def refresh(spark: SparkSession, path: str) -> Store:
    """Makes the statistics of the documents that count and opens the store."""
    at = tuple(epochs(spark, f"{path}/versions"))
    store = Store(spark, path, at)
    rows = store.postings().select("term", "doc_id", "tf", "dl")
    save = lambda df, name: df.write.mode("overwrite").parquet(f"{store.stats}/{name}")
    save(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).repartitionByRange("term").sortWithinPartitions("term"), "lexicon")
    n = store.versions().agg(F.count("*").cast("double").alias("n"))
    total = store.lexicon().agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total"))  # every token is in one posting, so no lengths are read
    save(n.crossJoin(total).select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("lbar")), "corpus_stats")
    full = with_df(rows, store.lexicon().select("term", "df")).crossJoin(F.broadcast(store.corpus_stats()))
    square = lambda x: F.sum(x * x)
    idf = {m: idf_weight(m, F.col("df"), F.col("n")) for m in IDF_MODES}
    log_tf = 1 + F.log10("tf")
    sums = [square(bm25_cell(F.col("tf"), F.col("dl"), F.col("lbar"), idf_weight("bm25", F.col("df"), F.col("n")), BM25_K)).alias("s_bm25")]
    for m, w in idf.items():
        sums += [square(w).alias(f"s0_{m}"), F.sum(w * w * F.col("tf")).alias(f"s1_{m}"), square(w * F.col("tf")).alias(f"s2_{m}"), square(w * log_tf).alias(f"sl_{m}")]
    grouped = full.groupBy("doc_id").agg(F.first("dl").alias("dl"), F.max("tf").alias("max_tf"), *sums)
    m_tf = F.col("max_tf")
    norms = {norm_name("bm25"): F.sqrt("s_bm25")}
    for m in idf:
        norms[norm_name("tfidf", "n", m)] = F.sqrt(f"s2_{m}")
        norms[norm_name("tfidf", "l", m)] = F.sqrt(f"sl_{m}")
        norms[norm_name("tfidf", "a", m)] = F.sqrt(0.25 * F.col(f"s0_{m}") + 0.5 * F.col(f"s1_{m}") / m_tf + 0.25 * F.col(f"s2_{m}") / (m_tf * m_tf))
    zero = lambda c, x: F.coalesce(c, F.lit(x))
    made = grouped.select("doc_id", "dl", "max_tf", *(c.alias(k) for k, c in norms.items()))
    every = store.versions().select("doc_id").join(made, "doc_id", "left")
    save(every.select("doc_id", zero(F.col("dl"), 0).alias("dl"), zero(F.col("max_tf"), 0).alias("max_tf"), *(zero(F.col(k), 0.0).alias(k) for k in norms)), "doc_stats")
    return store


def build(docs: DataFrame, path: str | None = None) -> Store:
    """Indexes docs as the first epoch of a store at path, or in the shared scratch folder."""
    path = path or scratch(docs.sparkSession)
    write_epoch(docs, path, 0)
    return refresh(docs.sparkSession, path)


def load(spark: SparkSession, path: str) -> Store:
    """Opens a store with statistics, up to the last epoch that they cover."""
    known = epochs(spark, f"{path}/versions")
    last = max((k for k in known if all(epochs_done(spark, f"{path}/stats/epoch={k}"))), default=None)
    if last is None:
        raise ValueError(f"no index at {path}")
    return Store(spark, path, tuple(k for k in known if k <= last))


def epochs_done(spark: SparkSession, path: str) -> list[bool]:
    return [exists(spark, f"{path}/{x}/_SUCCESS") for x in ("lexicon", "corpus_stats", "doc_stats")]

"""Incremental ingest: a stream of documents or feed articles becomes epochs of a stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store, digest, load, read_epochs, refresh, write_epoch
from ..plans.storage import epochs

#: What is read of a feed's response. Fixed names.
FEED = "response struct<results: array<struct<webUrl: string, sectionName: string, fields: struct<headline: string, bodyText: string, firstPublicationDate: string>, tags: array<struct<type: string, webTitle: string>>>>>"


def contributors(tags) -> Column:
    """Titles of a feed's contributor tags, joined by commas."""
    return F.concat_ws(",", F.transform(F.filter(tags, lambda t: t["type"] == "contributor"), lambda t: t["webTitle"]))


def feed_articles(responses: DataFrame, outlet: str = "guardian", column: str = "value", leaning: str = "LEFT", lead: str = "UNDEFINED") -> DataFrame:
    """The articles of JSON responses, as news rows without an id. A response that is no such JSON has none."""
    article = F.explode(F.from_json(column, FEED)["response"]["results"]).alias("a")
    return responses.select(article).select(
        F.col("a.fields.firstPublicationDate").alias("date"),
        F.col("a.fields.headline").alias("title"),
        F.col("a.fields.bodyText").alias("article"),
        F.lit(outlet).alias("outlet"),
        F.lit(lead).alias("lead_paragraph"),
        contributors(F.col("a.tags")).alias("authors"),
        F.col("a.sectionName").alias("domain"),
        F.col("a.webUrl").alias("url"),
        F.lit(leaning).alias("political_leaning"),
    )


def changed_documents(batch: DataFrame, store: Store | None) -> DataFrame:
    """Documents of a batch, once each, that the store lacks or has in another version."""
    batch = batch.dropDuplicates(["doc_id"])
    if store is None:
        return batch
    known = store.versions().select("doc_id", F.col("digest").alias("known"))
    return batch.withColumn("digest", digest(batch)).join(known, "doc_id", "left").where(~F.col("digest").eqNullSafe(F.col("known"))).select(*batch.columns)


def append(batch: DataFrame, path: str, epoch: int) -> None:
    """Writes the new and changed documents of a batch, their versions and postings as an epoch, and refreshes the statistics.

    Written again after a failure, the epoch replaces what it left: the batch is compared with earlier epochs only.
    """
    spark = batch.sparkSession
    earlier = tuple(k for k in epochs(spark, f"{path}/versions") if k < epoch)
    fresh = changed_documents(batch, Store(spark, path, earlier) if earlier else None)
    fresh.write.mode("overwrite").parquet(f"{path}/texts/epoch={epoch}")
    write_epoch(spark.read.schema(fresh.schema).parquet(f"{path}/texts/epoch={epoch}"), path, epoch)
    refresh(spark, path)


def texts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of an ingested store that count, in their last version."""
    store = load(spark, path)
    return read_epochs(store, "texts", schema).join(store.versions().select("doc_id", "epoch"), ["doc_id", "epoch"], "left_semi").drop("epoch")


def ingest(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Brings documents (doc_id, text; optional headline and more) into a store, changed ones in place of what they were. available_now: takes what is there and ends, for a daily run; else it runs on."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: append(batch, path, epoch + 1)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_per_window(events: DataFrame, every: str = "1 day", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """(start, n) per window; for a stream, with a watermark."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")

"""Corpus building: filters, samples per group, point look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def news_filter(news: DataFrame, publications: list[str], since: str | None = None) -> DataFrame:
    """Rows of the publications, with title, article and date, from a day on, by date."""
    kept = news.where(F.col("publication").isin(publications)).dropna(subset=["title", "article", "date"])
    return (kept.where(F.col("date") >= since) if since else kept).orderBy("date")


#: Columns of a news table in a CSV. Fixed names.
PREPARED = ("date_publish", "outlet", "headline", "lead", "body", "authors", "domain", "url", "political_leaning")


def prepared(news: DataFrame) -> DataFrame:
    """Rows with a headline, and the columns that the database takes."""
    return news.where(F.col("headline").isNotNull()).select(*PREPARED)


def group_sample(rows: DataFrame, group: str, n: int, key: Column) -> DataFrame:
    """n rows of each group, the first by key: a hash of an id makes it a sample that stays the same. Ranks are limited inside each task before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_r") <= n).drop("_r")


def balanced(parts: list[DataFrame], n: int, seed: int = 1) -> DataFrame:
    """Union of sources, n rows of it numbered from 1."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    drawn = every.withColumn("_k", F.rand(seed)).orderBy("_k").limit(n)
    return drawn.withColumn("doc_id", F.row_number().over(Window.orderBy("_k"))).drop("_k")


def point_lookup(news: DataFrame, doc_id: int) -> DataFrame:
    """The row with an id, pushed to the source; no row if there is none."""
    return news.where(F.col("doc_id") == doc_id)


def new_documents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch whose id is not stored, once each."""
    return batch.dropDuplicates(["doc_id"]).join(stored.select("doc_id"), "doc_id", "left_anti")

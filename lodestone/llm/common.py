"""What the training-data operators share: table access, shared-folder tables, sampling and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import BATCH_ROWS, SLICE_BYTES, bounded_batches, discard, fit_to_send, pa_schema, scratch, shared_dir, shuffles_removed, tidy, written  # noqa: F401

#: White space of the word rules: space and U+0009 to U+000D. Fixed value.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, mod: int) -> Column:
    """crc32 of an id as text, modulo mod: the rule that fixes held-out rows. A null id has no fold (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def sampled(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About bound rows, chosen by a hash of keys; all rows if there are no more than bound."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) for about bound labelled rows that satisfy keep.

    The sample of label rows has at most about bound rows, so it is broadcast whatever the size of docs.
    Of several labels of a document the largest counts; null ids and null labels don't.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = sampled(known.where(keep).groupBy("doc_id").agg(F.max("y").alias("y")), bound, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def shrink_heaps(spark: SparkSession) -> None:
    """Has the executors collect their garbage in full: only then their heaps, grown by what ran before, are handed back to the system."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def by_batch(df: DataFrame, kernel: Callable[[list[pa.Array]], list], schema: str, text: str | None = "text") -> DataFrame:
    """mapInArrow with kernel(columns) -> columns, over slices of a batch that hold about SLICE_BYTES of text.

    kernel may be a factory: a callable with attribute `make` is called once a task for the real kernel.
    """
    bounded_batches(df.sparkSession)
    types = pa_schema(schema)
    at = df.columns.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = kernel.make() if hasattr(kernel, "make") else kernel
        for batch in batches:
            for part in slices(batch, at):
                out = call(part.columns)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, types, strict=True)], schema=types)
        if hasattr(kernel, "release"):
            kernel.release()
        tidy()

    return df.mapInArrow(run, schema)


def rows_where(df: DataFrame, verdict: Callable[[list[str | None]], list[bool]], text: str = "text") -> DataFrame:
    """Rows of df, with all their columns and no shuffle, whose text passes verdict (a kernel, or a factory with `make`)."""

    bounded_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = verdict.make() if hasattr(verdict, "make") else verdict
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([bool(x) for x in call(part.column(at).to_pylist())], "bool"))
        tidy()

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, at: int | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if at is None or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    import numpy as np

    column = batch.column(at)
    sizes = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) * (8 if pa.types.is_list(column.type) else 1)
    part = (sizes[:-1] - sizes[0]) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)

"""Tables in the folder that the driver and all executors share, and what all Arrow kernels need."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, as in tests; a cluster has no folder to fall back on."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_swept: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. What an application leaves there goes when its driver ends."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/lodestone/{app}"
    if top not in _swept:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _swept.add(top)
    return f"{top}/{uuid.uuid4().hex}"


def compact(df: DataFrame) -> DataFrame:
    """df in as many partitions at most as keep every core busy four times, or a quarter of the shuffle's: for results of shuffles that hold a few numbers a row, whose files would be many and tiny."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends. Else they stay until the driver happens to collect its garbage, and all shuffles of a long job may stand on disk at once."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def unsorted_folders(spark: SparkSession) -> Iterator[None]:
    """Within, a task that writes a few folders has a file open in each, and rows keep their order: they aren't sorted by folder before."""
    before = spark.conf.get(_WRITERS, "0")
    spark.conf.set(_WRITERS, "16")
    try:
        yield
    finally:
        spark.conf.set(_WRITERS, before)


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, small: bool = False, **options) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: the lineage ends there and survives lost executors. small: compact() first. options: of the writer."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    with shuffles_removed(spark):
        (compact(df) if small else df).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more, lazily or again."""
    for x in tables:
        if path := _paths.pop(x, None):
            remove(x.sparkSession, path)


#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def fit_to_send(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of a few numbers marked for broadcast if they are few enough; more are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows a prefix in the names of a folder's entries."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in found.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(found)]
    return sorted(x.removeprefix(prefix) for x in names if x.startswith(prefix))


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete epoch=N folders of a path, ascending; of none there is no folder."""
    if not exists(spark, path):
        return []
    return sorted(int(x) for x in children(spark, path, "epoch=") if exists(spark, f"{path}/epoch={x}/_SUCCESS"))


#: Rows of text handed to one kernel call; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 4000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about SLICE_BYTES and BATCH_ROWS rows in this session: a batch stands in the JVM's and in Python's memory at once."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", SLICE_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key, None)
        if not (now or "").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def tidy() -> None:
    """Hands memory that is free back to the system: a Python worker lives on after its task, and others run beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pa_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)

"""Shared-folder staging: tables that cut lineage and survive a lost executor."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.shared import scratch

#: Bytes of a batch of rows between the JVM and a worker, for tables that are staged.
BATCH_BYTES = str(4 << 20)
_live: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _live:
        with contextlib.suppress(Exception):
            delete(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """A few narrow rows that are about to become many, dealt over as many partitions as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written: Arrow batches of at most :data:`BATCH_BYTES`, which bounds what they take beside the heaps of JVM and workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Workspace:
    """A private folder below the shared one, for the intermediate tables of one call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = scratch(spark, label)
        _live.append((spark, self.path))

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table read back; the plan starts anew there."""
        path = f"{self.path}/{name}"
        with _small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


def release(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, upon which Spark deletes shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Returns this process's freed pages, Arrow's and the C library's, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_used = [0]


def used(size: int, mb: int = 16) -> None:
    """Counts bytes that this process worked on, and gives freed memory back once in ``mb`` of them.

    A worker lives on for later tasks, so what its heap keeps would add up beside the executor's.
    """
    _used[0] += size
    if _used[0] >= mb << 20:
        _used[0] = 0
        release_memory()


def few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of a few rows, so that what is made of a piece stays small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        used(batch.nbytes)

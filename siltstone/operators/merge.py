"""Newest-wins merging, tombstones and compaction of versioned rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import DELETE, PUT

ENTRY = ["key", "seq", "op", "value"]


def latest(rows: DataFrame) -> DataFrame:
    """One row per key, that of the largest ``seq``; tombstones stay.

    A partial and a final aggregation of one struct per key: a hot key is
    reduced before the shuffle, and a null value never yields to an older one.
    """
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("_new")
    return rows.groupBy("key").agg(newest).select("key", "_new.seq", "_new.op", "_new.value")


def live(rows: DataFrame) -> DataFrame:
    """Drops tombstones; only ever after :func:`latest`."""
    return rows.where(F.col("op") == PUT)


def current(rows: DataFrame) -> DataFrame:
    """What a user sees: newest versions without deleted keys."""
    return live(latest(rows))


def ranked(runs: Sequence[DataFrame]) -> DataFrame:
    """Union of runs, newest first, with ``rank`` 0 for the newest."""
    return reduce(DataFrame.unionByName, [r.withColumn("rank", F.lit(k)) for k, r in enumerate(runs)])


def merge_ranked(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """One row per key: of the lowest ``rank``, and there of the largest seq; tombstones stay."""
    order = F.struct(-F.col(rank).cast("long"), F.col("seq"))
    return rows.groupBy("key").agg(F.max_by(F.struct(rank, "seq", "op", "value"), order).alias("_new")).select("key", f"_new.{rank}", "_new.seq", "_new.op", "_new.value")


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """k runs, newest first, to one row per key from the newest run that has it."""
    return merge_ranked(ranked(runs)).drop("rank")


def overlay(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Buffered rows over stored ones."""
    return merge_runs([memory, stored])


def shadowed(rows: DataFrame) -> DataFrame:
    """Versions that a newer version of their key hides, with the hiding op as ``by``."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    return rows.withColumn("_rn", F.row_number().over(order)).withColumn("by", F.first("op").over(order)).where("_rn > 1").drop("_rn")


def deleted_keys(rows: DataFrame) -> DataFrame:
    """Keys whose newest version is a tombstone that hides an older put."""
    newest = F.max_by("op", "seq").alias("op")
    return rows.groupBy("key").agg(newest, F.count_if(F.col("op") == PUT).alias("hidden_puts")).where((F.col("op") == DELETE) & (F.col("hidden_puts") > 0)).select("key", "hidden_puts")


def compact(rows: DataFrame, drop_tombstones: bool) -> DataFrame:
    """Rows of a compaction's output.  Tombstones may go only if nothing older lies below the target."""
    merged = latest(rows)
    return live(merged) if drop_tombstones else merged


def as_of(rows: DataFrame, seq: int) -> DataFrame:
    """Current rows as they were after version ``seq``: the cut comes before the merge."""
    return current(rows.where(F.col("seq") <= seq))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change feed between two sets of current rows: key, change ('insert', 'update', 'delete'), old_value, new_value."""
    old = before.select("key", F.col("value").alias("old_value"), F.lit(True).alias("_old"))
    new = after.select("key", F.col("value").alias("new_value"), F.lit(True).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "update")
    return old.join(new, "key", "full_outer").withColumn("change", kind).where("change IS NOT NULL").select("key", "change", "old_value", "new_value")


def change_log(rows: DataFrame, key: Column, seq: Column, deleted: Column, value: Column) -> DataFrame:
    """Any table as versioned rows."""
    op = F.when(deleted, DELETE).otherwise(PUT)
    return rows.select(key.alias("key"), seq.cast("long").alias("seq"), op.cast("byte").alias("op"), F.when(deleted, None).otherwise(value).alias("value"))

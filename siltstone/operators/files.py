"""Statistics of runs and levels, pruning, overlap and invariants, over file metadata as rows.

File rows: file_id, level, smallest, largest, entry_count, size.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import DELETE

#: Bookkeeping bytes counted for each buffered entry.
ENTRY_OVERHEAD = 64


def entry_size(key: Column, value: Column) -> Column:
    """Bytes an entry counts for in the buffer; a tombstone's value counts none."""
    return F.octet_length(key) + F.lit(ENTRY_OVERHEAD) + F.coalesce(F.octet_length(value), F.lit(0))


def run_stats(rows: DataFrame, run: str) -> DataFrame:
    """Per run: smallest, largest, entry_count, tombstones, size."""
    return rows.groupBy(run).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("entry_count"), F.count_if(F.col("op") == DELETE).alias("tombstones"), F.sum(entry_size(F.col("key"), F.col("value"))).cast("long").alias("size")
    )


def level_stats(files: DataFrame, num_levels: int) -> DataFrame:
    """Every level, empty ones too: files, entries, bytes."""
    per = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("entry_count").alias("entries"), F.sum("size").alias("bytes"))
    every = files.sparkSession.range(num_levels).select(F.col("id").cast("int").alias("level"))
    return every.join(per, "level", "left").select("level", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "entries", "bytes")])


def physical_counts(rows: DataFrame) -> DataFrame:
    """One row: physical rows, tombstones among them, keys, live keys, shadowed versions."""
    per = rows.groupBy("key").agg(F.count("*").alias("n"), F.max_by("op", "seq").alias("op"), F.count_if(F.col("op") == DELETE).alias("t"))
    sums = [F.sum("n"), F.sum("t"), F.count("*"), F.count_if(F.col("op") != DELETE), F.sum(F.col("n") - 1)]
    names = ["physical_rows", "tombstone_rows", "distinct_keys", "live_keys", "shadowed_rows"]
    return per.agg(*[F.coalesce(s, F.lit(0)).cast("long").alias(n) for s, n in zip(sums, names, strict=True)])


def overlaps(a_smallest: Column, a_largest: Column, b_smallest: Column, b_largest: Column) -> Column:
    """Closed intervals that meet."""
    return (a_smallest <= b_largest) & (a_largest >= b_smallest)


def file_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of files whose closed key ranges meet; metadata, a few rows."""
    a, b = left.alias("a"), right.alias("b")
    meets = overlaps(F.col("a.smallest"), F.col("a.largest"), F.col("b.smallest"), F.col("b.largest"))
    return a.join(b, meets & (F.col("a.file_id") != F.col("b.file_id"))).select(F.col("a.file_id").alias("left_id"), F.col("b.file_id").alias("right_id"))


def prune(files: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Files that a half-open range may touch."""
    if start is not None:
        files = files.where(F.col("largest") >= F.lit(start))
    if end is not None:
        files = files.where(F.col("smallest") < F.lit(end))
    return files


def find_file(files: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, file_id) of the one file of a non-overlapping level whose range holds each probed key, or null."""
    inside = (F.col("key") >= F.col("smallest")) & (F.col("key") <= F.col("largest"))
    return probes.join(F.broadcast(files.select("file_id", "smallest", "largest")), inside, "left").select("key", "file_id")


def level_budget(level: Column, base: int, factor: int) -> Column:
    """Bytes a level may hold: none below level 1, then ``base`` growing by ``factor``."""
    return F.when(level <= 0, F.lit(0.0)).otherwise(F.lit(base) * F.pow(F.lit(float(factor)), level - 1)).cast("long")


def over_budget(levels: DataFrame, base: int, factor: int) -> DataFrame:
    """Levels with their budget and whether they exceed it; level 0 and the bottom are never over."""
    budget = level_budget(F.col("level"), base, factor)
    bottom = F.max("level").over(Window.partitionBy(F.lit(0)))
    return levels.withColumn("budget", budget).withColumn("over", (F.col("level") >= 1) & (F.col("level") < bottom) & (F.col("bytes") > F.col("budget")))


def cheapest_candidate(files: DataFrame, level: int) -> DataFrame:
    """The file of ``level`` that meets the fewest files of the next, then the lowest id: file_id, overlaps."""
    above, below = files.where(F.col("level") == level), files.where(F.col("level") == level + 1)
    hits = file_overlaps(above, below).groupBy(F.col("left_id").alias("file_id")).agg(F.count("*").alias("n"))
    counted = above.select("file_id").join(hits, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("overlaps"))
    best = F.min_by(F.struct("file_id", "overlaps"), F.struct("overlaps", "file_id")).alias("b")
    return counted.agg(best).where("b IS NOT NULL").select("b.*")


def violations(files: DataFrame) -> DataFrame:
    """Neighbours within a level from 1 on whose ranges are not strictly apart: level, file_id, next_id."""
    order = Window.partitionBy("level").orderBy("smallest", "file_id")
    found = files.where("level >= 1").withColumn("next_id", F.lead("file_id").over(order)).withColumn("_next", F.lead("smallest").over(order))
    return found.where(F.col("largest") >= F.col("_next")).select("level", "file_id", "next_id")


def unsorted_rows(rows: DataFrame, run: str) -> DataFrame:
    """Rows whose key does not ascend strictly within their run in order of ``pos``."""
    order = Window.partitionBy(run).orderBy("pos")
    return rows.withColumn("_before", F.lag("key").over(order)).where(F.col("key") <= F.col("_before")).drop("_before")


def recency(files: DataFrame) -> DataFrame:
    """Level-0 files with rank 1 for the newest (largest id)."""
    return files.where("level = 0").select("file_id", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("file_id"))).alias("rank"))


def read_order(files: DataFrame) -> DataFrame:
    """Files newest first: level 0 by falling id, then each level by its smallest key; ``place`` from 0."""
    order = Window.partitionBy(F.lit(0)).orderBy("level", F.when(F.col("level") == 0, -F.col("file_id")).otherwise(0), "smallest")
    return files.withColumn("place", F.row_number().over(order) - 1)


def rotation(rows: DataFrame, capacity: int, group: str) -> DataFrame:
    """Which buffer each row lands in, if a buffer closes once its bytes reach ``capacity``: running size per ``group`` in order of seq."""
    size = entry_size(F.col("key"), F.col("value"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("buffer", F.floor(before / F.lit(capacity)).cast("long"))


def orphans(on_disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files on disk that no manifest names."""
    return on_disk.select("file_id").join(manifest.select("file_id"), "file_id", "left_anti")


def missing(on_disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files the manifest names that are not on disk."""
    return orphans(manifest, on_disk)

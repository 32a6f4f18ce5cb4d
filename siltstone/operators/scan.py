"""Point lookups and half-open, ordered range scans."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import PUT
from siltstone.operators.merge import current, latest


def in_range(rows: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """start <= key < end, either open; an inverted range is empty.  A filter on the merge key, so it commutes with the merge."""
    if start is not None:
        rows = rows.where(F.col("key") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("key") < F.lit(end))
    return rows


def scan(rows: DataFrame, start: Any = None, end: Any = None, limit: int | None = None) -> DataFrame:
    """Live (key, value) in ascending order of key."""
    found = current(in_range(rows, start, end)).select("key", "value").orderBy("key")
    return found if limit is None else found.limit(limit)


def keys(rows: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    return scan(rows, start, end).select("key")


def get_entry(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """For each key of ``probes``: status 'value', 'tombstone' or 'absent', and the value.

    The probes reduce the rows before the merge.
    """
    wanted = latest(rows.join(probes.select("key").distinct(), "key", "left_semi"))
    status = F.when(F.col("op").isNull(), "absent").when(F.col("op") == PUT, "value").otherwise("tombstone")
    return probes.join(wanted, "key", "left").select("key", status.alias("status"), "value")


def get_many(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Live (key, value) of the probed keys."""
    return current(rows.join(probes.select("key").distinct(), "key", "left_semi")).select("key", "value")


def contains(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, found): whether each probed key is live."""
    return get_entry(rows, probes).select("key", (F.col("status") == "value").alias("found"))


def lossy_text(value):
    """Binary column to text, with U+FFFD for bytes that are not UTF-8; never raises."""
    return F.make_valid_utf8(value.cast("string"))

"""Bloom filters as tables of bits: one row per (filter, bit)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optimal_k(bits_per_key: Column) -> Column:
    """Hash functions that minimise false positives: bits * ln 2, rounded, 1 to 30."""
    return F.greatest(F.lit(1), F.least(F.lit(30), F.bround(bits_per_key * F.lit(math.log(2))).cast("int")))


def bits_for_keys(num_keys: Column, bits_per_key: Column) -> Column:
    """Bits of a filter: at least 64, whole bytes."""
    return (F.ceil(F.greatest(F.lit(64), num_keys * bits_per_key) / F.lit(8.0)) * 8).cast("long")


def false_positive_rate(num_keys: Column, num_bits: Column, k: Column) -> Column:
    """Expected rate; 0 for a filter without keys or bits."""
    rate = F.pow(1 - F.exp(-(k * num_keys).cast("double") / num_bits), k.cast("double"))
    return F.when((num_keys <= 0) | (num_bits <= 0) | (k <= 0), F.lit(0.0)).otherwise(rate)


def positions(key: Column, num_bits: int, k: int) -> Column:
    """The k bits of a key, by double hashing; reduced before adding, so nothing overflows."""
    m = F.lit(num_bits).cast("long")
    first, second = F.pmod(F.xxhash64(key), m), F.pmod(F.xxhash64(F.lit(17), key), m)
    step = F.when(second == 0, F.lit(1).cast("long")).otherwise(second)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(first + i * step, m))


def build(keys: DataFrame, num_bits: int, k: int, by: list[str] | None = None) -> DataFrame:
    """The set bits (by..., bit) of the filters of ``keys`` (by..., key)."""
    return keys.select(*(by or []), F.explode(positions(F.col("key"), num_bits, k)).alias("bit")).distinct()


def might_contain(probes: DataFrame, bits: DataFrame, num_bits: int, k: int) -> DataFrame:
    """(key, maybe): false only for keys that are surely absent."""
    asked = probes.select("key", F.explode(F.array_distinct(positions(F.col("key"), num_bits, k))).alias("bit"))
    held = bits.select("bit", F.lit(1).alias("_set"))
    return asked.join(held, "bit", "left").groupBy("key").agg(F.every(F.col("_set").isNotNull()).alias("maybe"))

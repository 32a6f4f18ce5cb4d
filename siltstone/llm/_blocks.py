"""Buckets to bounded blocks, and links found inside a block.

A bucket of m members is cut into ceil(m / block) blocks; each pair of blocks
is one unit of work of at most 2 * block rows, so a hot bucket spreads over
many tasks and no pair of members is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs up to this size are compared pair by pair in vectors over all runs at once.
SMALL_RUN = 16


def in_blocks(members: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Members of buckets with two or more, once per pair of blocks (b1 <= b2) they take part in; ``own`` is their block.

    Bucket sizes come from a partial aggregation; bucket and member are the
    only columns shuffled for it.  They are joined by merge, never by
    broadcast: ``members`` often come from an explode, whose rows Spark counts
    as those before it, so it takes millions of buckets for few.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64(member), blocks.cast("long")).cast("int")
    pairs = F.when(F.col("_n") <= block, F.array(F.struct(F.lit(0).alias("b1"), F.lit(0).alias("b2")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, own).alias("b1"), F.greatest(j, own).alias("b2")))
    )
    return (
        members.join(sizes.hint("merge"), key)
        .withColumn("own", own)
        .withColumn("_pair", F.explode(pairs))
        .select(*members.columns, "own", F.col("_pair.b1").alias("b1"), F.col("_pair.b2").alias("b2"))
    )


def together(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one unit of work side by side in one partition."""
    return rows.repartition(key, "b1", "b2").sortWithinPartitions(key, "b1", "b2")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches to tables of whole runs, with the first row of each run and the number of rows at the end."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            column = table[k].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def spanning_links(
    starts: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], matrix: Callable[[int, int], np.ndarray | None] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep together what ``near`` links inside each run: linear in the rows, however dense the run.

    ``near(i, j)`` tells for index arrays, elementwise, whether rows i and j
    link.  Small runs give each of their links; a larger run gives a spanning
    forest found by a search that compares each row with all rows not yet
    reached.  ``matrix(a, b)``, if given, may tell at once for all pairs of
    rows a to b, or give None.
    """
    sizes = np.diff(starts)
    left, right = [], []
    small = (sizes > 1) & (sizes <= SMALL_RUN)
    if small.any():
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[:-1][small], sizes[small], strict=True)])
        run = np.repeat(np.flatnonzero(small), sizes[small])
        for shift in range(1, int(sizes[small].max())):
            same = np.flatnonzero(run[:-shift] == run[shift:])
            i, j = rows[same], rows[same + shift]
            hit = near(i, j)
            left.append(i[hit])
            right.append(j[hit])
    for k in np.flatnonzero(sizes > SMALL_RUN):
        waiting = np.arange(starts[k] + 1, starts[k + 1])
        reached = [int(starts[k])]
        known = matrix(int(starts[k]), int(starts[k + 1])) if matrix else None
        while len(waiting):
            if not reached:
                reached, waiting = [int(waiting[0])], waiting[1:]
                continue
            at = reached.pop()
            hit = near(np.full(len(waiting), at), waiting) if known is None else known[at - starts[k], waiting - starts[k]]
            found = waiting[hit]
            left.append(np.full(len(found), at))
            right.append(found)
            reached.extend(found.tolist())
            waiting = waiting[~hit]
    if not left:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._runtime import Workspace

#: Edges, as counted, up to which Spark may broadcast the least neighbours; its own estimate is the size of compressed files.
FEW_EDGES = 100_000


def _joined(edges: DataFrame, low: DataFrame, merge: bool) -> DataFrame:
    return edges.join(low.hint("merge") if merge else low, "a")


def _large_star(edges: DataFrame, merge: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        _joined(both, low, merge).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    )


def _small_star(edges: DataFrame, merge: bool) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = _joined(edges, low, merge).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """``edges`` (a, b: long) to (node, component): the least node reachable, for every node with an edge.

    Self loops and repeated edges are ignored.  Rounds run until the edge set
    no longer changes, each written to the shared folder.  Rows stay linear in
    the edges; a hub is aggregated before it is shuffled.  With more than
    :data:`FEW_EDGES` edges no round broadcasts anything.
    """
    directed = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, seen, step = work.stage(directed, f"{name}0"), None, 0
    while True:
        state = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        merge = state[0] > FEW_EDGES
        following = work.stage(_small_star(_large_star(current, merge), merge), f"{name}{step + 1}")
        work.drop(f"{name}{step}")
        current, step = following, step + 1
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

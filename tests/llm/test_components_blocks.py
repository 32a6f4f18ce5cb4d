from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm._blocks import in_blocks, spanning_links
from siltstone.llm._components import connected_components
from siltstone.llm._runtime import Workspace


def brute(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in list(parent)}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 150, size=(120, 2))] + [(k, k + 1) for k in range(1000, 1030)] + [(5000, k) for k in range(5001, 5040)]
    got = connected_components(spark.createDataFrame(edges + edges[:5], "a long, b long"), Workspace(spark, "test"))
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert {r.node: r.component for r in got.collect()} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_every_pair_of_a_bucket_meets_in_one_unit_of_work(spark, block):
    rows = spark.createDataFrame([(k % 3, k) for k in range(40)] + [(9, 99)], "key long, id long")
    units = {}
    for r in in_blocks(rows, "key", "id", block).collect():
        units.setdefault((r.key, r.b1, r.b2), []).append(r)
        assert r.own in (r.b1, r.b2)
    pairs = []
    for (key, b1, b2), members in units.items():
        for x in members:
            for y in members:
                if x.id < y.id and (b1 == b2 or x.own != y.own):
                    pairs.append((key, x.id, y.id))
    assert sorted(pairs) == sorted((k, a, b) for k in range(3) for a in range(k, 40, 3) for b in range(a + 3, 40, 3))


def test_bucket_sizes_are_not_broadcast(spark):
    """Spark counts the rows of an explode as those before it, which is far below what they are."""
    members = spark.range(500).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: k + F.col("id") % 100)).alias("key"))
    found = in_blocks(members, "key", "id", 100)
    assert found.count() >= 500 * 32
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_spanning_links_keep_components():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, size=200)
    starts = np.array([0, 1, 3, 12, 60, 200])
    for matrix in (None, lambda a, b: np.abs(x[a:b][:, None] - x[a:b][None, :]) <= 1):
        i, j = spanning_links(starts, lambda i, j: np.abs(x[i] - x[j]) <= 1, matrix)
        want = [(a, b) for s, e in zip(starts, starts[1:], strict=False) for a in range(s, e) for b in range(a + 1, e) if abs(x[a] - x[b]) <= 1]
        got = brute(zip(i.tolist(), j.tolist(), strict=True))
        assert got == brute(want)

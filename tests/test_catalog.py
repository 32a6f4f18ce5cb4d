"""Every catalogue query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _norm(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in frame.collect()), key=str)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(_norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def test_rows_only_queries(spark):
    rate = catalog.QUERIES["kv_bloom_fpr"](spark, str(DATA)).first()[0]
    assert 0 <= rate < 0.05
    assert catalog.QUERIES["kv_crc32"](spark, str(DATA)).count() > 0


def test_filter_grows_with_the_keys(spark):
    assert 0 < catalog.QUERIES["kv_bloom_fpr"](spark, "/root/testdata/sf0.1").first()[0] < 0.02


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_pushes_filters_and_columns_down(spark, tmp_path):
    from siltstone.operators import scan

    rows = spark.createDataFrame([(bytearray(b"k%03d" % k), k, 1, bytearray(b"v")) for k in range(50)], "key binary, seq long, op byte, value binary")
    rows.withColumn("unused", rows.seq).write.parquet(str(tmp_path / "run"))
    found = scan.scan(spark.read.parquet(str(tmp_path / "run")), b"k010", b"k020")
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert "unused" not in plan.split("== Physical Plan ==")[1]
    assert found.count() == 10

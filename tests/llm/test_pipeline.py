from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import queries

DATA = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    frame = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert sorted(names) == columns and sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == want


def test_every_stage_on_the_given_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("source", "source")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name in ("line_dedup", "mixing", "packing"):
            assert ids == {r.doc_id for r in before.select("doc_id").collect()}
        if name == "line_dedup":
            assert docs.where("n_chars <> length(text)").count() == 0
    fills = docs.groupBy("sequence_id").agg({"length": "sum", "offset": "min"}).collect()
    assert all(r[1] <= 2048 or r[2] <= 2048 for r in fills)


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    rows = [(k, f"text number {k} " * 30, "en", "s", 3, "mine", 0.5, k) for k in range(12)]
    rows += [(50, None, None, None, None, None, None, None), (51, "", "en", "s", 0, "m", 1.0, 1), (None, "null id", "de", "s", 7, "m", 1.0, 1), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic string, rate double, n_lines int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.where("toxic = 'mine'").count() > 0
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs, str(DATA)).where("piece = 0").count() == len(rows)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, str(DATA))
    assert kept.where("doc_id = 3").count() == 1


def test_run(spark):
    assert corpus_pipeline.run(spark, str(DATA)).columns[:2] == ["doc_id", "piece"]

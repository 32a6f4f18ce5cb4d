"""A training corpus from ``documents``: each stage works on all that the one before it kept.

Toxic documents go, boilerplate lines of a source go (a line stays in the
first document of its source that has it), one document of each group of near
duplicates stays, documents are repeated until languages have their target
shares (none is dropped: rates are 1 or more), and the result is packed into
sequences.  A stage takes (spark, docs, sf_dir); all but the last return the
columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import line_dedup, mixing, packing, simhash, toxicity
from siltstone.llm._runtime import Workspace
from siltstone.llm.tokens import tokenizer_path

#: Share of tokens of each language in the mix.
TARGETS = {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.16}

#: Classifiers, connected components and a genetic search have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator needs, and the whole row beside them, so that names of its own cannot clash."""
    return docs.select(*names, F.struct(*docs.columns).alias("_row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.flag_toxic(_apart(docs, "doc_id", "text"), labels).where("NOT toxic").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_apart(docs, "doc_id", "text", "source"), keep_first=True)
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(row.alias("_row")).select("_row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(_apart(docs, "doc_id", "text"), similarity=0.8, width=5).select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(_apart(docs, "doc_id", "text", "lang"), labels, TARGETS, floor=1.0)
    return mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written as Parquet and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.stage(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs

"""The registered queries on the smallest tables: contract columns and types, and digests against brute force."""

from __future__ import annotations

import struct
import zlib

import pytest
from tokenizers import Tokenizer

from siltstone.llm import queries
from siltstone.llm.tokens import tokenizer_path

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_line_dedup": {"doc_id": "bigint", "text": "string"},
    "op3_quality_cascade": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_mixing": {"doc_id": "bigint", "rate": "double"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op7_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "expected_severity": "double", "toxic": "boolean"},
    "op10_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
}
TABLE = {"op7_url_filter": "pages", "op8_embedding_dedup": "embeddings"}


def test_ten_operators_are_registered():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    if name in ("op1_best_fit_packing", "op10_chat_format"):
        assert rows
    else:
        assert len(rows) == spark.read.parquet(f"{DIR}/{TABLE.get(name, 'documents')}.parquet").count()


def test_store_digests(spark):
    tokenizer, at = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in queries.op6_token_store(spark, DIR).collect()}
    for doc in sorted(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()):
        ids = tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [2]
        r = got[doc.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)

"""One query per operator, over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat, embed_dedup, line_dedup, mixing, packing, quality, simhash, token_store, toxicity, url_filter
from siltstone.llm.tokens import tokenizer_path


#: Share of tokens of each domain (language) in the mix.
MIX_TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    mixed = mixing.mix(docs, _table(spark, sf_dir, "labels"), MIX_TARGETS)
    return mixed.select("doc_id", "tokens", F.map_from_arrays("domains", "posterior").alias("posterior"), "rate", "copies")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), width=3, max_bits=3)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and CRC-32 of the ids that the store gives back; Spark's crc32 is that of zlib, unsigned."""
    store = token_store.TokenStore.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return store.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.flag_toxic(docs, _table(spark, sf_dir, "labels")).drop("text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations, and of conversation -7 among them."""
    extra = spark.sql(
        r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    rows = rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    read = chat.read_chat(chat.format_chat(rows))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = """
WITH pages AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, site, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM pages
), totals AS (SELECT site, count(*) AS pages FROM pages GROUP BY site
), often AS (
  SELECT l.site, line FROM lines l JOIN totals t USING (site)
  GROUP BY l.site, line, pages HAVING count(*) >= 5 AND count(*) > pages * CAST(0.02 AS DOUBLE)
), drops AS (
  SELECT site, list(line) AS found FROM often GROUP BY site
), kept AS (
  SELECT doc_id, text, lines, CASE WHEN found IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(found, trim(x))) END AS rest
  FROM pages LEFT JOIN drops USING (site)
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(rest, chr(10)) END AS text,
  coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(rest), 0) AS n_dropped
FROM kept
"""

OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), sized AS (
  SELECT *, 15 + length(regexp_replace(role || text, '[\\<>#]', 'xx', 'g')) AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_token_store": op6_token_store,
    "op7_url_filter": op7_url_filter,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op10_chat_format": OP10_SQL,
}

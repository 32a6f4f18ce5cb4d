"""Queries by name over the driver's tables, each with its SQL equivalent.

The change log ``cl`` is built from ``events``: a user's events are versions
of one key, an error event is a delete.  Runs are its eighths, run 0 newest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import codec
from siltstone.functions.bloom import DEFAULT_BITS_PER_KEY, bits_for_keys, optimal_k
from siltstone.operators import bloom, files, merge, scan
from siltstone.shared import scratch

RUNS = 8
PROBES = ["u000001", "u000007", "u000042", "u000077", "u000149", "u999999"]
LOW, HIGH = "u000020", "u000090"
AS_OF, LATER = 4000, 8000

CL = """cl AS (
  SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id AS seq,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '|' || props END AS value, event_id % 8 AS run
  FROM events
), newest AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1
)"""

FILES = """f AS (
  SELECT CAST(run AS BIGINT) AS file_id, CAST(CASE WHEN run < 4 THEN 0 ELSE run // 4 END AS INT) AS level, min(key) AS smallest, max(key) AS largest,
    count(*) AS entry_count, sum(octet_length(encode(key)) + 64 + coalesce(octet_length(encode(value)), 0)) AS size
  FROM cl GROUP BY run
)"""

#: Files of two non-overlapping levels, cut from the keys by number: level 1 in 30s, level 2 in 20s shifted by 10.
RANGED = """r AS (
  SELECT level * 100 + part AS file_id, level, min(key) AS smallest, max(key) AS largest, count(*) AS entry_count, count(*) * 100 AS size
  FROM (SELECT key, 1 AS level, CAST(substr(key, 2) AS BIGINT) // 30 AS part FROM newest
        UNION ALL SELECT key, 2, (CAST(substr(key, 2) AS BIGINT) + 10) // 20 FROM newest) GROUP BY level, part
)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    key = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    rows = merge.change_log(e, key, F.col("event_id"), F.col("event_type") == "error", F.concat_ws("|", "event_type", "props"))
    return rows


def _runs(rows: DataFrame) -> list[DataFrame]:
    return [merge.latest(rows.where(F.col("seq") % RUNS == k)) for k in range(RUNS)]


def _with_run(rows: DataFrame) -> DataFrame:
    return rows.withColumn("run", (F.col("seq") % RUNS).cast("long"))


def _files(rows: DataFrame) -> DataFrame:
    stats = files.run_stats(_with_run(rows), "run")
    level = F.when(F.col("run") < 4, 0).otherwise(F.floor(F.col("run") / 4)).cast("int")
    return stats.select(F.col("run").alias("file_id"), level.alias("level"), "smallest", "largest", "entry_count", "size")


def _ranged(rows: DataFrame) -> DataFrame:
    n = F.substring("key", 2, 6).cast("long")
    cut = F.explode(F.array(F.struct(F.lit(1).alias("level"), F.floor(n / 30).alias("part")), F.struct(F.lit(2).alias("level"), F.floor((n + 10) / 20).alias("part"))))
    parts = merge.latest(rows).select("key", cut.alias("c")).select("key", "c.level", "c.part")
    out = parts.groupBy("level", "part").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("entry_count"))
    return out.select((F.col("level") * 100 + F.col("part")).cast("long").alias("file_id"), "level", "smallest", "largest", "entry_count", (F.col("entry_count") * 100).alias("size"))


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in PROBES], "key string")


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(name: str, sql: str | None, *, on: str = "cl", extra: str = ""):
    """Registers f(spark, sf_dir, rows); rows is the change log."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, change_log(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {CL}{', ' + extra if extra else ''} {sql}" if on == "cl" else sql
        return f

    return add


_PROBE_SQL = "p AS (SELECT unnest(['" + "','".join(PROBES) + "']) AS key)"


@_query("kv_latest_live", "SELECT key, value FROM newest WHERE op = 1")
def _(spark, sf_dir, rows):
    return merge.current(rows).select("key", "value")


@_query("kv_latest_with_tombstones", "SELECT key, seq, op, value FROM newest")
def _(spark, sf_dir, rows):
    return merge.latest(rows).withColumn("op", F.col("op").cast("int"))


@_query("kv_get_entry", "SELECT p.key, CASE WHEN op IS NULL THEN 'absent' WHEN op = 1 THEN 'value' ELSE 'tombstone' END AS status, value FROM p LEFT JOIN newest USING (key)", extra=_PROBE_SQL)
def _(spark, sf_dir, rows):
    return scan.get_entry(rows, _probes(spark))


@_query("kv_get_many", "SELECT key, value FROM newest JOIN p USING (key) WHERE op = 1", extra=_PROBE_SQL)
def _(spark, sf_dir, rows):
    return scan.get_many(rows, _probes(spark))


@_query("kv_contains", "SELECT p.key, EXISTS (SELECT 1 FROM newest n WHERE n.key = p.key AND op = 1) AS found FROM p", extra=_PROBE_SQL)
def _(spark, sf_dir, rows):
    return scan.contains(rows, _probes(spark))


def _as_of_sql(seq: int) -> str:
    return f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM cl WHERE seq <= {seq}) WHERE rn = 1 AND op = 1"


@_query("kv_get_at_seq", _as_of_sql(AS_OF))
def _(spark, sf_dir, rows):
    return merge.as_of(rows, AS_OF).select("key", "value")


@_query(
    "kv_snapshot_vs_live",
    f"SELECT key, a.value AS snapshot_value, b.value AS live_value, a.value IS DISTINCT FROM b.value AS changed FROM ({_as_of_sql(AS_OF)}) a FULL JOIN (SELECT key, value FROM newest WHERE op = 1) b USING (key)",
)
def _(spark, sf_dir, rows):
    old, new = merge.as_of(rows, AS_OF).select("key", F.col("value").alias("snapshot_value")), merge.current(rows).select("key", F.col("value").alias("live_value"))
    return old.join(new, "key", "full_outer").withColumn("changed", ~F.col("snapshot_value").eqNullSafe(F.col("live_value")))


def _range_sql(where: str, tail: str = "") -> str:
    return f"SELECT key, value FROM newest WHERE op = 1 AND {where} ORDER BY key{tail}"


@_query("kv_scan_range", _range_sql(f"key >= '{LOW}' AND key < '{HIGH}'"))
def _(spark, sf_dir, rows):
    return scan.scan(rows, LOW, HIGH)


@_query("kv_scan_open_start", _range_sql(f"key < '{HIGH}'"))
def _(spark, sf_dir, rows):
    return scan.scan(rows, None, HIGH)


@_query("kv_scan_open_end", _range_sql(f"key >= '{LOW}'"))
def _(spark, sf_dir, rows):
    return scan.scan(rows, LOW, None)


@_query("kv_scan_inverted", _range_sql(f"key >= '{HIGH}' AND key < '{LOW}'"))
def _(spark, sf_dir, rows):
    return scan.scan(rows, HIGH, LOW)


@_query("kv_keys_range", f"SELECT key FROM newest WHERE op = 1 AND key >= '{LOW}' AND key < '{HIGH}'")
def _(spark, sf_dir, rows):
    return scan.keys(rows, LOW, HIGH)


@_query("kv_scan_limit", _range_sql(f"key >= '{LOW}'", " LIMIT 10"))
def _(spark, sf_dir, rows):
    return scan.scan(rows, LOW, limit=10)


_RUN_NEWEST = """per_run AS (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS a FROM cl),
merged AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run) AS b FROM per_run WHERE a = 1)"""


@_query("kv_merge_runs", "SELECT key, value FROM merged WHERE b = 1 AND op = 1", extra=_RUN_NEWEST)
def _(spark, sf_dir, rows):
    return merge.live(merge.merge_runs(_runs(rows))).select("key", "value")


@_query("kv_merge_sources", "SELECT key, CAST(run AS INT) AS source, CAST(op AS INT) AS op FROM merged WHERE b = 1", extra=_RUN_NEWEST)
def _(spark, sf_dir, rows):
    return merge.merge_ranked(merge.ranked(_runs(rows))).select("key", F.col("rank").alias("source"), F.col("op").cast("int").alias("op"))


@_query("kv_overlay", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN run = 0 THEN 0 ELSE 1 END, seq DESC) AS rn FROM cl) WHERE rn = 1 AND op = 1")
def _(spark, sf_dir, rows):
    memory = F.col("seq") % RUNS == 0
    return merge.live(merge.overlay(merge.latest(rows.where(memory)), merge.latest(rows.where(~memory)))).select("key", "value")


@_query("kv_tombstone_shadow", "SELECT n.key, count(*) AS hidden_puts FROM newest n JOIN cl USING (key) WHERE n.op = 2 AND cl.op = 1 GROUP BY n.key")
def _(spark, sf_dir, rows):
    return merge.deleted_keys(rows)


@_query("kv_shadowed_versions", "SELECT cl.key, cl.seq, CAST(cl.op AS INT) AS op, CAST(n.op AS INT) AS hidden_by FROM cl JOIN newest n ON cl.key = n.key AND cl.seq < n.seq")
def _(spark, sf_dir, rows):
    return merge.shadowed(rows).select("key", "seq", F.col("op").cast("int").alias("op"), F.col("by").cast("int").alias("hidden_by"))


@_query("kv_compact_keep_ts", "SELECT CAST(op AS INT) AS op, count(*) AS entries FROM newest GROUP BY op")
def _(spark, sf_dir, rows):
    return merge.compact(rows, False).groupBy(F.col("op").cast("int").alias("op")).agg(F.count("*").alias("entries"))


@_query("kv_compact_drop_ts", "SELECT key, seq, value FROM newest WHERE op = 1")
def _(spark, sf_dir, rows):
    return merge.compact(rows, True).select("key", "seq", "value")


@_query(
    "kv_physical_vs_live",
    "SELECT count(*) AS physical_rows, count(*) FILTER (op = 2) AS tombstone_rows, count(DISTINCT key) AS distinct_keys, (SELECT count(*) FROM newest WHERE op = 1) AS live_keys, count(*) - count(DISTINCT key) AS shadowed_rows FROM cl",
)
def _(spark, sf_dir, rows):
    return files.physical_counts(rows)


@_query(
    "kv_run_stats",
    "SELECT run, min(key) AS smallest, max(key) AS largest, count(*) AS entry_count, count(*) FILTER (op = 2) AS tombstones, CAST(sum(octet_length(encode(key)) + 64 + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS size FROM cl GROUP BY run",
)
def _(spark, sf_dir, rows):
    return files.run_stats(_with_run(rows), "run")


@_query(
    "kv_level_stats",
    "SELECT CAST(l.level AS INT) AS level, count(f.file_id) AS files, CAST(coalesce(sum(entry_count), 0) AS BIGINT) AS entries, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT unnest([0, 1, 2, 3]) AS level) l LEFT JOIN f ON f.level = l.level GROUP BY l.level",
    extra=FILES,
)
def _(spark, sf_dir, rows):
    return files.level_stats(_files(rows), 4)


@_query("kv_run_overlaps", "SELECT a.file_id AS left_id, b.file_id AS right_id FROM f a JOIN f b ON a.smallest <= b.largest AND a.largest >= b.smallest AND a.file_id <> b.file_id", extra=FILES)
def _(spark, sf_dir, rows):
    found = _files(rows)
    return files.file_overlaps(found, found)


@_query("kv_prune_runs", f"SELECT file_id, CAST(level AS INT) AS level FROM r WHERE largest >= '{LOW}' AND smallest < '{HIGH}'", extra=RANGED)
def _(spark, sf_dir, rows):
    return files.prune(_ranged(rows), LOW, HIGH).select("file_id", "level")


@_query("kv_find_file", "SELECT p.key, r.file_id FROM p LEFT JOIN (SELECT * FROM r WHERE level = 1) r ON p.key BETWEEN r.smallest AND r.largest", extra=f"{RANGED}, {_PROBE_SQL}")
def _(spark, sf_dir, rows):
    return files.find_file(_ranged(rows).where("level = 1"), _probes(spark))


@_query(
    "kv_level_budget",
    """SELECT CAST(level AS INT) AS level, bytes, CASE WHEN level = 0 THEN 0 ELSE CAST(2000 * pow(4, level - 1) AS BIGINT) END AS budget,
    level IN (1, 2) AND bytes > CASE WHEN level = 0 THEN 0 ELSE CAST(2000 * pow(4, level - 1) AS BIGINT) END AS over
    FROM (SELECT l.level, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT unnest([0, 1, 2, 3]) AS level) l LEFT JOIN r ON r.level = l.level GROUP BY l.level)""",
    extra=RANGED,
)
def _(spark, sf_dir, rows):
    return files.over_budget(files.level_stats(_ranged(rows), 4), 2000, 4).select("level", "bytes", "budget", "over")


@_query(
    "kv_pick_candidate",
    "SELECT a.file_id, count(b.file_id) AS overlaps FROM r a LEFT JOIN r b ON b.level = 2 AND a.smallest <= b.largest AND a.largest >= b.smallest WHERE a.level = 1 GROUP BY a.file_id ORDER BY 2, 1 LIMIT 1",
    extra=RANGED,
)
def _(spark, sf_dir, rows):
    return files.cheapest_candidate(_ranged(rows), 1)


@_query(
    "kv_invariants",
    "SELECT level, file_id, next_id FROM (SELECT CAST(level AS INT) AS level, file_id, largest, lead(file_id) OVER w AS next_id, lead(smallest) OVER w AS n FROM f WHERE level >= 1 WINDOW w AS (PARTITION BY level ORDER BY smallest, file_id)) WHERE largest >= n",
    extra=FILES,
)
def _(spark, sf_dir, rows):
    return files.violations(_files(rows))


@_query("kv_invariants_hold", "SELECT level, file_id, next_id FROM (SELECT CAST(level AS INT) AS level, file_id, largest, lead(file_id) OVER w AS next_id, lead(smallest) OVER w AS n FROM r WINDOW w AS (PARTITION BY level ORDER BY smallest)) WHERE largest >= n", extra=RANGED)
def _(spark, sf_dir, rows):
    return files.violations(_ranged(rows))


@_query("kv_l0_rank", "SELECT file_id, CAST(row_number() OVER (ORDER BY file_id DESC) AS INT) AS rank FROM f WHERE level = 0", extra=FILES)
def _(spark, sf_dir, rows):
    return files.recency(_files(rows))


@_query("kv_read_order", "SELECT file_id, CAST(row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -file_id ELSE 0 END, smallest) - 1 AS INT) AS place FROM r", extra=RANGED)
def _(spark, sf_dir, rows):
    return files.read_order(_ranged(rows)).select("file_id", "place")


@_query("kv_orphans", "SELECT file_id FROM f WHERE file_id NOT IN (SELECT file_id FROM f WHERE level = 0)", extra=FILES)
def _(spark, sf_dir, rows):
    found = _files(rows)
    return files.orphans(found, found.where("level = 0"))


@_query("kv_missing", "SELECT file_id FROM f WHERE file_id NOT IN (SELECT file_id FROM f WHERE file_id % 3 = 0)", extra=FILES)
def _(spark, sf_dir, rows):
    found = _files(rows)
    return files.missing(found.where("file_id % 3 = 0"), found)


@_query("kv_entry_size", "SELECT key, CAST(sum(octet_length(encode(key)) + 64 + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS size FROM cl GROUP BY key")
def _(spark, sf_dir, rows):
    return rows.groupBy("key").agg(F.sum(files.entry_size(F.col("key"), F.col("value"))).cast("long").alias("size"))


@_query(
    "kv_memtable_rotation",
    "SELECT key, seq, CAST(coalesce(sum(octet_length(encode(key)) + 64 + coalesce(octet_length(encode(value)), 0)) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1024 AS BIGINT) AS buffer FROM cl",
)
def _(spark, sf_dir, rows):
    return files.rotation(rows, 1024, "key").select("key", "seq", "buffer")


_GRID = [(n, b) for n in (0, 1, 100, 1000, 12000) for b in (1, 4, 10, 16)]


@_query(
    "kv_bloom_params",
    "SELECT n, b, greatest(1, least(30, CAST(round(b * ln(2)) AS INT))) AS k, CAST(ceil(greatest(64, n * b) / 8.0) * 8 AS BIGINT) AS bits, "
    "round(CASE WHEN n <= 0 THEN 0.0 ELSE pow(1 - exp(-greatest(1, least(30, round(b * ln(2)))) * n / (ceil(greatest(64, n * b) / 8.0) * 8)), greatest(1, least(30, round(b * ln(2))))) END, 9) AS rate "
    "FROM (VALUES " + ", ".join(f"({n}, {b})" for n, b in _GRID) + ") g(n, b)",
    on="none",
)
def _(spark, sf_dir, rows):
    grid = spark.createDataFrame(_GRID, "n int, b int")
    k, bits = bloom.optimal_k(F.col("b")), bloom.bits_for_keys(F.col("n"), F.col("b"))
    return grid.withColumn("k", k).withColumn("bits", bits).withColumn("rate", F.round(bloom.false_positive_rate(F.col("n"), F.col("bits"), F.col("k")), 9))


@_query("kv_bloom_false_negatives", "SELECT CAST(0 AS BIGINT) AS false_negatives, count(*) AS keys FROM newest")
def _(spark, sf_dir, rows):
    keys = merge.latest(rows).select("key")
    bits, k = bits_for_keys(keys.count(), DEFAULT_BITS_PER_KEY), optimal_k(DEFAULT_BITS_PER_KEY)
    answers = bloom.might_contain(keys, bloom.build(keys, bits, k), bits, k)
    return answers.agg(F.count_if(~F.col("maybe")).alias("false_negatives"), F.count("*").alias("keys"))


@_query("kv_bloom_fpr", None)
def _(spark, sf_dir, rows):
    keys = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")).distinct()
    absent = keys.select(F.concat(F.lit("absent-"), "key").alias("key"))
    bits, k = bits_for_keys(keys.count(), DEFAULT_BITS_PER_KEY), optimal_k(DEFAULT_BITS_PER_KEY)
    return bloom.might_contain(absent, bloom.build(keys, bits, k), bits, k).agg(F.avg(F.col("maybe").cast("int")).alias("rate"))


@_query("kv_crc32", None)
def _(spark, sf_dir, rows):
    return rows.select("key", "seq", F.crc32(F.coalesce("value", F.lit("")).cast("binary")).alias("crc"))


@_query("kv_log_records", "SELECT key, seq, 17 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) AS bytes FROM cl")
def _(spark, sf_dir, rows):
    framed = codec.record_columns(F.col("op"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    return rows.select("key", "seq", F.octet_length(framed).cast("long").alias("bytes"))


@_query("kv_base64_roundtrip", "SELECT key, base64(encode(key)) AS text, key AS back FROM newest")
def _(spark, sf_dir, rows):
    text = F.base64(F.col("key").cast("binary"))
    return merge.latest(rows).select("key", text.alias("text"), F.unbase64(text).cast("string").alias("back"))


@_query("kv_file_names", "SELECT file_id, format('run-{:06d}.parquet', file_id) AS name, file_id AS parsed FROM f", extra=FILES)
def _(spark, sf_dir, rows):
    name = F.format_string("run-%06d.parquet", "file_id")
    return _files(rows).select("file_id", name.alias("name"), F.regexp_extract(name, r"^run-(\d+)\.parquet$", 1).cast("long").alias("parsed"))


@_query("kv_usage_ratio", "SELECT run, round(coalesce(count(*) FILTER (op = 2) / nullif(count(*), 0), 0), 9) AS ratio FROM cl GROUP BY run")
def _(spark, sf_dir, rows):
    return _with_run(rows).groupBy("run").agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("op") == 2), F.count("*")), F.lit(0.0)), 9).alias("ratio"))


@_query(
    "kv_change_feed",
    f"""SELECT key, CASE WHEN NOT has_old THEN 'insert' WHEN NOT has_new THEN 'delete' ELSE 'update' END AS change, old_value, new_value FROM (
    SELECT key, a.value AS old_value, b.value AS new_value, a.key IS NOT NULL AS has_old, b.key IS NOT NULL AS has_new FROM ({_as_of_sql(AS_OF)}) a FULL JOIN ({_as_of_sql(LATER)}) b USING (key)
    ) WHERE NOT (has_old AND has_new AND old_value IS NOT DISTINCT FROM new_value)""",
)
def _(spark, sf_dir, rows):
    return merge.changes(merge.as_of(rows, AS_OF), merge.as_of(rows, LATER))


@_query("kv_orders_latest", "SELECT o_custkey AS key, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS priority, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey", on="none")
def _(spark, sf_dir, rows):
    o = _table(spark, sf_dir, "orders")
    log = merge.change_log(o, F.col("o_custkey"), F.col("o_orderkey"), F.lit(False), F.struct("o_orderpriority", "o_totalprice"))
    return merge.current(log).select("key", "seq", F.col("value.o_orderpriority").alias("priority"), F.col("value.o_totalprice").alias("price"))


@_query(
    "kv_lineitem_merge",
    """SELECT key, ship, price FROM (SELECT l_partkey AS key, l_returnflag, CAST(l_shipdate AS DATE) AS ship, l_extendedprice AS price,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) AS rn FROM lineitem) WHERE rn = 1 AND l_returnflag <> 'R'""",
    on="none",
)
def _(spark, sf_dir, rows):
    li = _table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag")
    newest = li.groupBy(F.col("l_partkey").alias("key")).agg(F.max_by(F.struct("l_returnflag", "l_shipdate", "l_extendedprice"), order).alias("n"))
    return newest.where("n.l_returnflag <> 'R'").select("key", F.col("n.l_shipdate").cast("date").alias("ship"), F.col("n.l_extendedprice").alias("price"))


@_query("kv_table_scan", "SELECT key, value FROM newest WHERE op = 1")
def _(spark, sf_dir, rows):
    """The stored table end to end: four batches, a compaction, a scan."""
    from siltstone.table import Table

    with Table.open(spark, scratch(spark, "table"), l0_trigger=3) as table:
        bounds = rows.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75])).first()[0]
        edges = [None, *bounds, None]
        for k in range(4):
            part = rows if edges[k] is None else rows.where(F.col("seq") > edges[k])
            part = part if edges[k + 1] is None else part.where(F.col("seq") <= edges[k + 1])
            table.upsert(part.select(F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"), "seq"), order_by="seq")
        table.compact_all()
        return table.scan_frame().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


from siltstone.plans import stateful  # noqa: E402

QUERIES |= stateful.QUERIES
ORACLE_SQL |= stateful.ORACLE_SQL

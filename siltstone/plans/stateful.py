"""Queries that open a table, write to it and look at what it did, each with its SQL equivalent.

Small tables (``nation``, ``region``) go through single puts and deletes,
large ones through batches.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.buffer import WriteBuffer
from siltstone.errors import SiltError
from siltstone.operators import DELETE, PUT, files, scan
from siltstone.shared import scratch
from siltstone.sources.log import LogDataSource, WriteAheadLog, read_log
from siltstone.sources.manifest import FileMeta, Manifest
from siltstone.streaming.ingest import upsert_stream
from siltstone.table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Batches that orders are dealt into by their number.
BATCHES = 4


def _query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str]]:
    """(number, name, region's name) of the 25 nations, by number."""
    rows = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sorted((r.n_nationkey, r.n_name, r.r_name) for r in rows.collect())


def _open(spark: SparkSession, **knobs) -> Table:
    return Table.open(spark, scratch(spark, "table"), **{"auto_compact": False, "log_path": _log_path()} | knobs)


def _log_path() -> str:
    """A log lies on the driver's own disk, wherever the table is."""
    return os.path.join(tempfile.mkdtemp(prefix="silt-log-"), "buffer.log")


def _text(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customers: key, seq (the order's number) and value."""
    o = _read(spark, sf_dir, "orders")
    return o.select(F.format_string("c%08d", "o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value"))


NATIONS = "n AS (SELECT n_nationkey AS k, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"
ORDERS = "o AS (SELECT format('c{:08d}', o_custkey) AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders)"


def _latest_order(where: str, by: str = "seq") -> str:
    return f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {by} DESC) AS rn FROM o WHERE {where}) WHERE rn = 1"


@_query("kv_put_delete_flush", f"WITH {NATIONS} SELECT name AS key, CASE WHEN k % 10 = 0 THEN 'again' ELSE region END AS value FROM n WHERE k % 5 <> 0 OR k % 10 = 0")
def _(spark, sf_dir):
    """Puts, deletes over a flushed run, and puts that stay in the buffer."""
    with _open(spark) as t:
        rows = _nations(spark, sf_dir)
        t.put_many((name, region) for _, name, region in rows)
        t.flush()
        for k, name, _ in rows:
            if k % 5 == 0:
                t.delete(name)
            if k % 10 == 0:
                t.put(name, "again")
        return _text(t.scan_frame())


@_query("kv_buffer_range", f"WITH {NATIONS} SELECT row_number() OVER (ORDER BY name) - 1 AS place, name AS key, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS op, CASE WHEN k % 3 = 0 THEN NULL ELSE region END AS value FROM n WHERE name >= 'C' AND name < 'R'")
def _(spark, sf_dir):
    """A range of the write buffer in order, tombstones kept."""
    held = WriteBuffer()
    for k, name, region in _nations(spark, sf_dir):
        held.set(name.encode(), k + 1, None if k % 3 == 0 else region.encode())
    rows = [(i, k.decode(), o, None if v is None else v.decode()) for i, (k, _, o, v) in enumerate(held.rows(b"C", b"R"))]
    return spark.createDataFrame(rows, "place long, key string, op int, value string")


@_query("kv_buffer_size", f"WITH {NATIONS} SELECT count(*) AS entries, count(*) FILTER (k % 3 = 0) AS tombstones, CAST(sum(octet_length(encode(name)) + 64 + CASE WHEN k % 3 = 0 THEN 0 ELSE 4 END) AS BIGINT) AS bytes, sum(octet_length(encode(name)) + 64 + CASE WHEN k % 3 = 0 THEN 0 ELSE 4 END) >= 2048 AS is_full FROM n")
def _(spark, sf_dir):
    """Bytes of a buffer whose values were replaced once."""
    held = WriteBuffer(2048)
    for k, name, region in _nations(spark, sf_dir):
        held.set(name.encode(), k + 1, region.encode())
        held.set(name.encode(), k + 100, None if k % 3 == 0 else b"four")
    return spark.createDataFrame([(len(held), held.tombstones, held.size, held.is_full)], "entries long, tombstones long, bytes long, is_full boolean")


@_query("kv_snapshot_pin", f"WITH {NATIONS} SELECT 'snapshot' AS seen, name AS key, region AS value FROM n UNION ALL SELECT 'live', name, 'new' FROM n WHERE k % 4 = 0")
def _(spark, sf_dir):
    """A snapshot is what it was, after deletes, puts, a flush and a full compaction."""
    t, rows = _open(spark), _nations(spark, sf_dir)
    t.put_many((name, region) for _, name, region in rows[:12])
    t.flush()
    t.put_many((name, region) for _, name, region in rows[12:])
    snap = t.snapshot()
    for k, name, _ in rows:
        t.put(name, "new") if k % 4 == 0 else t.delete(name)
    t.flush()
    t.compact_all()
    seen = _text(snap.frame()).select(F.lit("snapshot").alias("seen"), "key", "value")
    return seen.unionByName(_text(t.scan_frame()).select(F.lit("live").alias("seen"), "key", "value"))


@_query("kv_pinned_files", f"WITH {NATIONS}, c AS (SELECT count(DISTINCT region) AS runs FROM n) SELECT 'flushed' AS stage, runs AS live, runs AS on_disk, 0 AS pinned, 0 AS pending FROM c UNION ALL SELECT 'compacted', 1, runs + 1, runs, runs FROM c UNION ALL SELECT 'released', 1, 1, 0, 0 FROM c")
def _(spark, sf_dir):
    """Files of a run a region: replaced ones stay on disk while a snapshot holds them."""
    out = []
    with _open(spark) as t:

        def note(stage: str) -> None:
            s = t.stats()
            out.append((stage, s.file_count, len(t.storage.names("data")), s.pinned_files, s.pending_deletes))

        rows = _nations(spark, sf_dir)
        for region in sorted({r[2] for r in rows}):
            t.put_many((name, own) for _, name, own in rows if own == region)
            t.flush()
        note("flushed")
        with t.snapshot():
            t.compact_all()
            note("compacted")
        note("released")
    return spark.createDataFrame(out, "stage string, live long, on_disk long, pinned long, pending long")


@_query("kv_recovery", f"WITH {NATIONS}, last AS (SELECT max(k) AS k FROM n) SELECT name AS key, region AS value, (SELECT count(*) - 1 FROM n) AS recovered, true AS truncated FROM n WHERE k < (SELECT k FROM last)")
def _(spark, sf_dir):
    """Rows that were never flushed come back from the log; its torn last record does not."""
    root, log = scratch(spark, "table"), _log_path()
    with Table.open(spark, root, log_path=log) as t:
        t.put_many((name, region) for _, name, region in _nations(spark, sf_dir))
    os.truncate(log, os.path.getsize(log) - 4)
    with Table.open(spark, root, log_path=log) as t:
        s = t.stats()
        return _text(t.scan_frame()).select("key", "value", F.lit(s.recovered_records).cast("long").alias("recovered"), F.lit(s.recovery_truncated).alias("truncated"))


@_query("kv_siltlog", f"WITH {NATIONS} SELECT k AS pos, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS op, name AS key, CASE WHEN k % 3 = 0 THEN NULL ELSE region END AS value, 17 + octet_length(encode(name)) + CASE WHEN k % 3 = 0 THEN 0 ELSE octet_length(encode(region)) END AS size, CAST(coalesce(sum(17 + octet_length(encode(name)) + CASE WHEN k % 3 = 0 THEN 0 ELSE octet_length(encode(region)) END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM n")
def _(spark, sf_dir):
    """The log as a Spark source: one row a record, with its place in the file."""
    log = WriteAheadLog(_log_path())
    for k, name, region in _nations(spark, sf_dir):
        log.append(DELETE if k % 3 == 0 else PUT, name.encode(), b"" if k % 3 == 0 else region.encode())
    log.close()
    spark.dataSource.register(LogDataSource)
    rows = spark.read.format("siltlog").load(log.path)
    return rows.select("pos", F.col("op").cast("int").alias("op"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "size", F.col("offset").alias("at"))


@_query("kv_log_rewrite", f"WITH {NATIONS} SELECT name AS key, region AS value, 1 AS rewrites FROM n WHERE k >= 20")
def _(spark, sf_dir):
    """A log rewritten to the rows that are still buffered."""
    log, rows = WriteAheadLog(_log_path()), _nations(spark, sf_dir)
    for _, name, region in rows:
        log.append(PUT, name.encode(), region.encode())
    log.rewrite((PUT, name.encode(), region.encode()) for k, name, region in rows if k >= 20)
    log.close()
    return spark.createDataFrame([(r.key.decode(), r.value.decode(), log.rewrites) for r in read_log(log.path).records], "key string, value string, rewrites int")


def _batches(t: Table, orders: DataFrame) -> None:
    for k in range(BATCHES):
        t.upsert(orders.where(F.col("seq") % BATCHES == k), order_by="seq")


@_query("kv_leveled_compaction", f"WITH {ORDERS} " + _latest_order("true", f"seq % {BATCHES} DESC, seq"))
def _(spark, sf_dir):
    """Batches with leveled compaction after each; every level from 1 on stays without overlap."""
    with _open(spark, auto_compact=True, l0_trigger=2, level_bytes=65536, level_factor=4, target_file_bytes=32768) as t:
        _batches(t, _orders(spark, sf_dir))
        t.manifest.check()
        return _text(t.scan_frame())


@_query("kv_compaction_rows", f"WITH {ORDERS}, d AS (SELECT count(DISTINCT key) AS n FROM o), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT key, seq % {BATCHES} FROM o)) SELECT 'before' AS stage, b.n AS stored, {BATCHES} AS level0, 0 AS bottom FROM b UNION ALL SELECT 'after', d.n, 0, d.n FROM d")
def _(spark, sf_dir):
    """Stored rows and rows of the first and the last level, before and after all files are merged."""
    out = []
    with _open(spark) as t:
        _batches(t, _orders(spark, sf_dir))
        s = t.stats()
        out.append(("before", s.stored_entries, s.level_files[0], s.level_entries[-1]))
        t.compact_all()
        s = t.stats()
        out.append(("after", s.stored_entries, s.level_files[0], s.level_entries[-1]))
    return spark.createDataFrame(out, "stage string, stored long, level0 long, bottom long")


@_query("kv_tombstones_dropped", f"WITH {NATIONS} SELECT count(*) + count(*) FILTER (k % 2 = 0) AS before, count(*) FILTER (k % 2 = 1) AS after, false AS known FROM n")
def _(spark, sf_dir):
    """A merge into the bottom level drops deleted keys, which are then never-seen."""
    with _open(spark) as t:
        rows = _nations(spark, sf_dir)
        t.put_many((name, region) for _, name, region in rows)
        t.flush()
        for k, name, _ in rows:
            if k % 2 == 0:
                t.delete(name)
        t.flush()
        before = t.stats().stored_entries
        t.compact_all()
        return spark.createDataFrame([(before, t.stats().stored_entries, t.get_entry(rows[0][1])[0])], "before long, after long, known boolean")


@_query("kv_as_of_version", f"WITH {ORDERS} " + _latest_order(f"seq % {BATCHES} = 0"))
def _(spark, sf_dir):
    """The table as its manifest stood after the first of several batches."""
    with _open(spark) as t:
        orders = _orders(spark, sf_dir)
        t.upsert(orders.where(F.col("seq") % BATCHES == 0), order_by="seq")
        version = t.manifest.version
        t.upsert(orders.where(F.col("seq") % BATCHES != 0), order_by="seq")
        return _text(t.as_of(version))


@_query("kv_stream_upsert", f"WITH {NATIONS} SELECT name AS key, CASE WHEN k % 5 = 0 THEN 'since' ELSE region END AS value FROM n")
def _(spark, sf_dir):
    """A stream taken in batch by batch; a replay of its last batch changes nothing."""
    folder, root = scratch(spark, "stream"), scratch(spark, "table")
    rows = _nations(spark, sf_dir)
    changes = spark.createDataFrame([(name, region, k) for k, name, region in rows], "key string, value string, seq long")
    changes.repartition(3).write.parquet(folder)
    with Table.open(spark, root, auto_compact=False, log_path=_log_path()) as t:
        query = upsert_stream(spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(folder), t, f"{folder}-checkpoint", order_by="seq", availableNow=True)
        query.awaitTermination()
        for k, name, _ in rows:
            if k % 5 == 0:
                t.put(name, "since")
        t.upsert(changes, order_by="seq", batch_id=(f"{folder}-checkpoint", dict(t.manifest.batches)[f"{folder}-checkpoint"]))
        return _text(t.scan_frame())


@_query("kv_unsorted_rows", "SELECT o_custkey AS run, o_orderkey AS pos, o_orderpriority AS key FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE o_orderpriority <= before")
def _(spark, sf_dir):
    """Rows that do not ascend strictly within their run."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("key"))
    return files.unsorted_rows(o, "run").select("run", "pos", "key")


@_query("kv_get_str", f"WITH {NATIONS} SELECT name AS key, CASE WHEN k % 3 = 0 THEN NULL ELSE region || chr(65533) END AS value, k % 3 <> 0 AS found, k % 3 = 0 AS deleted FROM n")
def _(spark, sf_dir):
    """Single gets as text, with a replacement for bytes that are no UTF-8, and what gets tell apart."""
    out = []
    with _open(spark) as t:
        rows = _nations(spark, sf_dir)
        t.put_many((name, region.encode() + b"\xff") for _, name, region in rows)
        t.flush()
        for k, name, _ in rows:
            if k % 3 == 0:
                t.delete(name)
        for _, name, _ in rows:
            known, value = t.get_entry(name)
            out.append((name, t.get_str(name), t.contains(name), known and value is None))
    return spark.createDataFrame(out, "key string, value string, found boolean, deleted boolean")


@_query("kv_lossy_text", f"WITH {NATIONS} SELECT name AS key, region || chr(65533) || 'z' AS value FROM n")
def _(spark, sf_dir):
    """Columns of bytes as text, with a replacement for what is no UTF-8."""
    rows = spark.createDataFrame([(name, bytearray(region.encode() + b"\xffz")) for _, name, region in _nations(spark, sf_dir)], "key string, value binary")
    return rows.select("key", scan.lossy_text(F.col("value")).alias("value"))


def _ranged(spark: SparkSession, sf_dir: str) -> list[FileMeta]:
    """A file a region in level 1 (key ranges apart), and the regions' halves in level 0."""
    rows = _nations(spark, sf_dir)
    out = []
    for k in range(5):
        own = [(n, r) for n, _, r in rows if n // 5 == k]
        low, high = (b"n%02d" % own[0][0], b"n%02d" % own[-1][0])
        out += [FileMeta(k + 1, 1, low, high, len(own), 100 * len(own)), FileMeta(k + 11, 0, b"n%02d" % (own[0][0] // 2), high, 2, 20)]
    return out


_RANGED_SQL = """r AS (SELECT k // 5 AS g, min(k) AS low, max(k) AS high, count(*) AS c FROM n GROUP BY k // 5), m AS (
  SELECT g + 1 AS file_id, 1 AS level, format('n{:02d}', low) AS smallest, format('n{:02d}', high) AS largest, c AS entry_count, c * 100 AS size FROM r
  UNION ALL SELECT g + 11, 0, format('n{:02d}', low // 2), format('n{:02d}', high), 2, 20 FROM r)"""


@_query("kv_manifest_order", f"WITH {NATIONS}, {_RANGED_SQL} SELECT row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -file_id ELSE 0 END, smallest) - 1 AS place, file_id, level, smallest, largest FROM m")
def _(spark, sf_dir):
    """A manifest written as JSON and read back, its files in the order of reading."""
    m = Manifest.from_json(Manifest(next_file_id=100, files=tuple(_ranged(spark, sf_dir))).to_json())
    return spark.createDataFrame([(k, f.file_id, f.level, f.smallest.decode(), f.largest.decode()) for k, f in enumerate(m.in_order())], "place long, file_id long, level int, smallest string, largest string")


@_query("kv_manifest_replaced", f"WITH {NATIONS}, {_RANGED_SQL} SELECT file_id, level, CAST(1 AS BIGINT) AS version FROM m WHERE NOT (level = 0 AND file_id < 14) UNION ALL SELECT 100, 2, 1")
def _(spark, sf_dir):
    """The manifest after a compaction took files out and put one in."""
    m = Manifest(next_file_id=100, files=tuple(_ranged(spark, sf_dir)))
    after = m.replaced([f for f in m.level(0) if f.file_id < 14], [FileMeta(100, 2, b"a", b"z", 1, 1)], next_file_id=101)
    return spark.createDataFrame([(f.file_id, f.level, after.version) for f in after.files], "file_id long, level int, version long")


@_query("kv_manifest_level_totals", f"WITH {NATIONS}, {_RANGED_SQL} SELECT level, count(*) AS files, CAST(sum(entry_count) AS BIGINT) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY level")
def _(spark, sf_dir):
    """Files, entries and bytes of each level, from the manifest's own sums."""
    m = Manifest(next_file_id=100, files=tuple(_ranged(spark, sf_dir)))
    return spark.createDataFrame([(n, len(m.level(n)), sum(f.entry_count for f in m.level(n)), m.level_bytes(n)) for n in (0, 1)], "level int, files long, entries long, bytes long")


@_query("kv_cache_figures", f"WITH {NATIONS} SELECT count(*) AS misses, 2 * count(*) AS hits, 3 * count(*) AS gets FROM n")
def _(spark, sf_dir):
    """Hits and misses of three rounds of gets of one stored run."""
    with _open(spark) as t:
        rows = _nations(spark, sf_dir)
        t.put_many((name, region) for _, name, region in rows)
        t.flush()
        for _ in range(3):
            for _, name, _ in rows:
                t.get(name)
        s = t.stats()
        return spark.createDataFrame([(s.cache_misses, s.cache_hits, s.gets)], "misses long, hits long, gets long")


@_query("kv_probe_figures", f"WITH {NATIONS}, r AS (SELECT region, min(name) AS low, max(name) AS high FROM n GROUP BY region) SELECT count(*) FILTER (name BETWEEN low AND high) AS probed, count(*) FILTER (NOT name BETWEEN low AND high) AS pruned FROM n, r")
def _(spark, sf_dir):
    """Files that gets look into and files that their key ranges rule out, a run a region."""
    with _open(spark) as t:
        rows = _nations(spark, sf_dir)
        for region in sorted({r[2] for r in rows}):
            t.put_many((name, own) for _, name, own in rows if own == region)
            t.flush()
        for _, name, _ in rows:
            t.get(name)
        s = t.stats()
        return spark.createDataFrame([(s.files_probed, s.files_pruned)], "probed long, pruned long")


@_query("kv_write_figures", f"WITH {NATIONS} SELECT count(*) AS puts, count(*) FILTER (k % 2 = 0) AS deletes, 1 AS flushes, count(*) FILTER (k % 2 = 0) AS buffered, count(*) FILTER (k % 2 = 0) AS tombstones, count(*) AS stored FROM n")
def _(spark, sf_dir):
    """Counters of an open table."""
    with _open(spark) as t:
        rows = _nations(spark, sf_dir)
        t.put_many((name, region) for _, name, region in rows)
        t.flush()
        for k, name, _ in rows:
            if k % 2 == 0:
                t.delete(name)
        s = t.stats()
        return spark.createDataFrame([(s.puts, s.deletes, s.flushes, s.buffer_entries, s.buffer_tombstones, s.stored_entries)], "puts long, deletes long, flushes long, buffered long, tombstones long, stored long")


@_query("kv_auto_flush", f"WITH {NATIONS} SELECT count(*) // 6 AS flushes, 6 * (count(*) // 6) AS stored, count(*) % 6 AS buffered FROM n")
def _(spark, sf_dir):
    """A buffer that takes six entries of 80 bytes is flushed each time it is full."""
    with _open(spark, buffer_capacity=480) as t:
        for k, _, _ in _nations(spark, sf_dir):
            t.put(f"key{k:05d}", "8 bytes.")
        s = t.stats()
        return spark.createDataFrame([(s.flushes, s.stored_entries, s.buffer_entries)], "flushes long, stored long, buffered long")


@_query("kv_orphans_deleted", f"WITH {NATIONS} SELECT name AS key, region AS value, 1 AS folders FROM n")
def _(spark, sf_dir):
    """A run that no manifest names, as a crash leaves it, is gone after the next open."""
    root, log = scratch(spark, "table"), _log_path()
    with Table.open(spark, root, log_path=log, auto_compact=False) as t:
        t.put_many((name, region) for _, name, region in _nations(spark, sf_dir))
        t.flush()
        spark.range(3).write.parquet(t.storage.at("data/run-000999"))
    with Table.open(spark, root, log_path=log) as t:
        return _text(t.scan_frame()).select("key", "value", F.lit(len(t.storage.names("data"))).alias("folders"))


@_query("kv_outcomes", "SELECT * FROM (VALUES ('put of a number', 'InvalidArgumentError'), ('repeated keys of a batch', 'InvalidArgumentError'), ('unknown version', 'InvalidArgumentError'), ('overlap in a level', 'CorruptionError'), ('put after close', 'ClosedError'), ('second close', 'fine'), ('closed snapshot', 'ClosedError')) AS v(action, outcome)")
def _(spark, sf_dir):
    """What is refused, and as what."""
    t, out = _open(spark), []

    def tell(action: str, work: Callable) -> None:
        outcome = "fine"
        try:
            work()
        except SiltError as error:
            outcome = type(error).__name__
        out.append((action, outcome))

    rows = _nations(spark, sf_dir)
    tell("put of a number", lambda: t.put(1, "x"))
    tell("repeated keys of a batch", lambda: t.upsert(_read(spark, sf_dir, "nation").select(F.lit("k").alias("key"), F.col("n_name").alias("value"))))
    tell("unknown version", lambda: t.as_of(99))
    clash = FileMeta(1, 1, b"a", rows[0][1].encode() + b"z", 1, 1)
    tell("overlap in a level", lambda: Manifest(next_file_id=9).replaced((), [clash, FileMeta(2, 1, b"a", b"b", 1, 1)]))
    snap = t.snapshot()
    snap.close()
    t.close()
    tell("put after close", lambda: t.put("k", "v"))
    tell("second close", t.close)
    tell("closed snapshot", lambda: snap.get("k"))
    return spark.createDataFrame(out, "action string, outcome string")


@_query("kv_cursor", f"WITH {NATIONS} SELECT row_number() OVER (ORDER BY name) - 1 AS place, name AS key, region AS value FROM n WHERE name >= 'E' AND name < 'M'")
def _(spark, sf_dir):
    """A cursor over a range in order, from stored and buffered rows; what is put after it opened is not seen."""
    with _open(spark) as t:
        rows = _nations(spark, sf_dir)
        t.put_many((name, region) for k, name, region in rows if k % 2)
        t.flush()
        t.put_many((name, region) for k, name, region in rows if k % 2 == 0)
        with contextlib.closing(t.scan("E", "M")) as cursor:
            t.put("FIRST SEEN LATER", "x")
            out = [(k, key.decode(), value.decode()) for k, (key, value) in enumerate(cursor)]
    return spark.createDataFrame(out, "place long, key string, value string")

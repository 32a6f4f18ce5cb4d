"""A versioned key-value table: a buffer and log on the driver, sorted Parquet runs under a manifest.

The order of every change is: write new data, commit the manifest, delete old
data; so a crash leaves either the old state or the new one, and files that no
manifest names, which the next open deletes.

Two locks: maintenance (flushes, batches, compactions) runs one at a time under
its own, while the lock of the state is held only to rotate the buffer, to
commit a manifest or to look a key up in memory.  So puts and gets go on while
runs are written: a full buffer becomes immutable and stays readable until its
run is committed, and a get pins the files it reads.
"""

from __future__ import annotations

import contextlib
import os
import weakref
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, replace
from threading import RLock
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siltstone.buffer import DEFAULT_CAPACITY, WriteBuffer
from siltstone.cache import DEFAULT_BYTES, LookupCache
from siltstone.errors import ClosedError, CorruptionError, InvalidArgumentError
from siltstone.functions.codec import to_bytes
from siltstone.operators import DELETE, PUT, merge, planner, scan
from siltstone.sources.log import Replay, WriteAheadLog
from siltstone.sources.manifest import FileMeta, Manifest, ManifestStore, find_file
from siltstone.sources.storage import Storage

ENTRY_SCHEMA = "key binary, seq long, op byte, value binary"
DATA = "data"
#: Rounds of compaction that maintenance runs at most, and buffer sizes at which a writer waits for it.
MAX_ROUNDS, STALL_FACTOR = 16, 2


@dataclass(frozen=True)
class TableStats:
    """Figures of an open table."""

    version: int
    buffer_entries: int
    buffer_tombstones: int
    buffer_bytes: int
    buffer_capacity: int
    immutable_entries: int
    log_rewrites: int
    log_bytes: int
    file_count: int
    stored_entries: int
    stored_bytes: int
    level_files: tuple[int, ...]
    level_entries: tuple[int, ...]
    level_bytes: tuple[int, ...]
    puts: int
    deletes: int
    gets: int
    scans: int
    flushes: int
    compactions: int
    compacted_files: int
    files_probed: int
    files_pruned: int
    open_snapshots: int
    pinned_files: int
    pending_deletes: int
    recovered_records: int
    recovery_truncated: bool
    cache_hits: int
    cache_misses: int
    cache_usage: int

    @property
    def buffer_usage_ratio(self) -> float:
        return self.buffer_bytes / self.buffer_capacity if self.buffer_capacity else 0.0

    def __str__(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in asdict(self).items())

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([Row(**{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()})])


class ScanCursor:
    """Iterates (key, value) of a frozen scan in order, a partition at a time; gives its snapshot back when it ends or is closed."""

    def __init__(self, snapshot: Snapshot, frame: DataFrame, owned: bool):
        self._snapshot, self._frame, self._owned = snapshot, frame, owned
        self._rows: Iterator[Row] | None = None
        self.closed = False

    def __iter__(self) -> ScanCursor:
        return self

    def __next__(self) -> tuple[bytes, bytes]:
        if self.closed:
            raise StopIteration
        self._snapshot._check()
        if self._rows is None:
            self._snapshot.scan_count += 1
            self._rows = self._frame.toLocalIterator()
        try:
            row = next(self._rows)
        except StopIteration:
            self.close()
            raise
        return bytes(row[0]), bytes(row[1])

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            if self._owned:
                self._snapshot.close()

    def __enter__(self) -> ScanCursor:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __del__(self) -> None:
        with contextlib.suppress(Exception):
            self.close()


class Snapshot:
    """The table as it was when taken: the manifest's files, pinned, and a copy of the buffer."""

    def __init__(self, table: Table, number: int, manifest: Manifest, memory: list[tuple]):
        self._table, self.snapshot_id, self.manifest, self._memory = table, number, manifest, memory
        self.closed, self.scan_count, self.files_pruned = False, 0, 0

    def _check(self) -> None:
        if self.closed:
            raise ClosedError("the snapshot is closed")

    @property
    def file_ids(self) -> set[int]:
        return self.manifest.file_ids

    @property
    def memory_entries(self) -> int:
        return len(self._memory)

    @property
    def file_count(self) -> int:
        return len(self.manifest.files)

    def rows(self, start: bytes | None = None, end: bytes | None = None) -> tuple[DataFrame, bool]:
        """All versions in a range, and whether keys may repeat: one sorted level alone needs no merge."""
        self._check()
        files = [f for f in self.manifest.in_order() if f.meets(start, end)]
        self.files_pruned += len(self.manifest.files) - len(files)
        memory = [r for r in self._memory if (start is None or r[0] >= start) and (end is None or r[0] < end)]
        stored = self._table._read(files)
        if memory:
            buffered = self._table.spark.createDataFrame([(bytearray(k), s, o, None if v is None else bytearray(v)) for k, s, o, v in memory], ENTRY_SCHEMA)
            stored = buffered.unionByName(stored) if files else buffered
        single = not memory and len({f.level for f in files}) <= 1 and all(f.level > 0 for f in files)
        return scan.in_range(stored, start, end), not single

    def frame(self, start: Any = None, end: Any = None) -> DataFrame:
        """Live (key, value), not ordered."""
        low, high = (None if x is None else to_bytes(x, n) for x, n in ((start, "start"), (end, "end")))
        rows, repeats = self.rows(low, high)
        return merge.live(merge.latest(rows) if repeats else rows).select("key", "value")

    def scan(self, start: Any = None, end: Any = None) -> ScanCursor:
        return ScanCursor(self, self.frame(start, end).orderBy("key"), owned=False)

    items = scan

    def keys(self, start: Any = None, end: Any = None) -> Iterator[bytes]:
        return (k for k, _ in self.scan(start, end))

    def get_entry(self, key: Any) -> tuple[bool, bytes | None]:
        """(True, value), (True, None) for a tombstone, (False, None) for a key never seen or compacted away."""
        self._check()
        wanted = to_bytes(key)
        held = max((r[1:] for r in self._memory if r[0] == wanted), default=None, key=lambda r: r[0])
        return self._table._newest(self.manifest, held, wanted)

    def get(self, key: Any) -> bytes | None:
        return self.get_entry(key)[1]

    def get_str(self, key: Any, encoding: str = "utf-8") -> str | None:
        value = self.get(key)
        return None if value is None else value.decode(encoding, errors="replace")

    def contains(self, key: Any) -> bool:
        return self.get(key) is not None

    def close(self) -> None:
        """Idempotent; files that only this snapshot held are deleted."""
        if not self.closed:
            self.closed = True
            self._table._release(self)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Table:
    """Open with :meth:`open`.  Pins are held in this process; a table has one writing process at a time."""

    def __init__(self, spark: SparkSession, root: str, *, buffer_capacity: int, log_sync: bool, log_path: str | None, auto_flush: bool, num_levels: int, l0_trigger: int, level_bytes: int, level_factor: int, target_file_bytes: int, auto_compact: bool, bloom_keys: int, cache_bytes: int):
        if num_levels < 2 or l0_trigger < 1 or bloom_keys < 0:
            raise InvalidArgumentError("num_levels must be 2 or more, l0_trigger 1 or more, bloom_keys 0 or more")
        self.spark, self.storage = spark, Storage(spark, root)
        self.auto_flush, self.auto_compact = auto_flush, auto_compact
        self.l0_trigger, self.level_bytes, self.level_factor = l0_trigger, level_bytes, level_factor
        self.target_file_bytes, self.bloom_keys = target_file_bytes, bloom_keys
        self.cache = LookupCache(cache_bytes)
        self._buffer, self._lock, self._maintenance = WriteBuffer(buffer_capacity), RLock(), RLock()
        self._immutable: WriteBuffer | None = None
        self._reading: Counter[int] = Counter()
        self._snapshots: dict[int, Snapshot] = {}
        self._pending: dict[int, FileMeta] = {}
        self._next_snapshot, self.closed = 1, False
        self._counts = dict.fromkeys(("puts", "deletes", "gets", "scans", "flushes", "compactions", "compacted_files", "files_probed", "files_pruned"), 0)
        self._manifests = ManifestStore(self.storage)
        if log_path is None:
            local = self.storage.root.removeprefix("file://").removeprefix("file:") if self.storage.root.startswith("file:") else None
            log_path = os.path.join(local, "_log", "buffer.log") if local else None
        self._log = WriteAheadLog(log_path, log_sync) if log_path else None
        self.manifest = self._load(num_levels)
        self.recovery = self._recover()

    @classmethod
    def open(
        cls,
        spark: SparkSession,
        root: str,
        *,
        buffer_capacity: int = DEFAULT_CAPACITY,
        log_sync: bool = False,
        log_path: str | None = None,
        auto_flush: bool = True,
        num_levels: int = 3,
        l0_trigger: int = planner.L0_TRIGGER,
        level_bytes: int = planner.LEVEL_BYTES,
        level_factor: int = planner.LEVEL_FACTOR,
        target_file_bytes: int = 128 << 20,
        auto_compact: bool = True,
        bloom_keys: int = 1_000_000,
        cache_bytes: int = DEFAULT_BYTES,
    ) -> Table:
        """Opens or creates a table.

        ``num_levels`` of an existing table wins over the argument.
        ``bloom_keys``: expected keys of a run for its Parquet Bloom filters,
        0 for none.  The log lies beside a local table; for a remote one name
        a local ``log_path``, or buffered rows are not logged.
        """
        given = {k: v for k, v in locals().items() if k not in ("cls", "spark", "root")}
        return cls(spark, root, **given)

    # --- opening

    def _load(self, num_levels: int) -> Manifest:
        manifest = self._manifests.load()
        on_disk = set(self.storage.names(DATA))
        if manifest is None:
            manifest = Manifest(num_levels=num_levels)
            if on_disk:
                manifest = self._adopt(manifest, sorted(on_disk))
                self._manifests.commit(manifest)
            return manifest
        named = {f.path.split("/")[1] for f in manifest.files}
        lost = [f.path for f in manifest.files if not self.storage.exists(self.storage.at(f.path))]
        if lost:
            raise CorruptionError(f"the manifest names files that do not exist: {lost}")
        for name in sorted(on_disk - named):
            self.storage.delete(self.storage.at(DATA, name))
        return manifest

    def _adopt(self, manifest: Manifest, folders: list[str]) -> Manifest:
        """Runs found without a manifest become level 0, newest by the highest version."""
        files = []
        for k, name in enumerate(folders, 1):
            files += self._describe(f"{DATA}/{name}", 0, k, whole=True)
        top = max((f.max_seq for f in files), default=0)
        return manifest.replaced((), files, next_file_id=len(folders) + 1, next_seq=top + 1)

    def _recover(self) -> Replay:
        replay = self._log.recover() if self._log else Replay()
        for record in replay.records:
            self._buffer.set(record.key, self._take_seq(), None if record.is_delete else record.value)
        return replay

    # --- writing

    def _check(self) -> None:
        if self.closed:
            raise ClosedError("the table is closed")

    def _take_seq(self) -> int:
        seq = self.manifest.next_seq
        self.manifest = replace(self.manifest, next_seq=seq + 1)
        return seq

    def _write(self, key: bytes, value: bytes | None) -> None:
        with self._lock:
            self._check()
            if self._log:
                self._log.append(DELETE if value is None else PUT, key, value or b"")
            self._buffer.set(key, self._take_seq(), value)
            self._counts["deletes" if value is None else "puts"] += 1
            full, stalled = self._buffer.is_full, self._buffer.size >= STALL_FACTOR * self._buffer.capacity
        if full and self.auto_flush and self._maintenance.acquire(blocking=stalled):
            try:
                self.flush()
            finally:
                self._maintenance.release()

    def put(self, key: Any, value: Any) -> None:
        self._write(to_bytes(key), to_bytes(value, "value"))

    def delete(self, key: Any) -> None:
        """Writes a tombstone, whether or not the key exists."""
        self._write(to_bytes(key), None)

    def put_many(self, pairs: Mapping | Iterable[tuple[Any, Any]]) -> int:
        """Number of pairs, repeated keys counted.  Arguments are checked before anything is written."""
        items = [(to_bytes(k), to_bytes(v, "value")) for k, v in (pairs.items() if isinstance(pairs, Mapping) else pairs)]
        for key, value in items:
            self._write(key, value)
        return len(items)

    def upsert(self, batch: DataFrame, order_by: str | None = None, batch_id: tuple[str, int] | None = None) -> int:
        """Writes (key, value, op) as one run, atomically; returns its rows.

        ``batch_id``: (source, number): a number not above the last one that
        the table took from the source is skipped.

        ``op`` (1 put, 2 delete) may be absent: then a null value is a delete.
        Keys may repeat only with ``order_by``, whose largest value wins.
        """
        self._check()
        fields = batch.columns
        op = F.col("op").cast("byte") if "op" in fields else F.when(F.col("value").isNull(), DELETE).otherwise(PUT).cast("byte")
        key = F.col("key").cast("binary")
        rows = batch.select(key.alias("key"), op.alias("op"), F.when(op == PUT, F.coalesce(F.col("value").cast("binary"), F.lit(b""))).alias("value"), *([F.col(order_by).alias("_order")] if order_by else []))
        if order_by:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "_order").alias("r")).select("key", "r.op", "r.value")
        elif not rows.groupBy("key").count().where("count > 1").isEmpty():
            raise InvalidArgumentError("keys repeat in the batch; name the column that orders them")
        with self._maintenance:
            taken = dict(self.manifest.batches)
            if batch_id and batch_id[1] <= taken.get(batch_id[0], -1):
                return 0
            self._drain()
            with self._lock:
                seq = self._take_seq()
            files = self._store(rows.withColumn("seq", F.lit(seq).cast("long")), 0, clustered=False)
            self._commit((), files, batches=tuple(sorted((taken | dict([batch_id])).items())) if batch_id else self.manifest.batches)
            self._counts["flushes"] += 1
        if self.auto_compact:
            self.maybe_compact()
        return sum(f.entry_count for f in files)

    def _store(self, rows: DataFrame, level: int, clustered: bool, size_hint: int = 0, keys: int | None = None) -> list[FileMeta]:
        """Writes sorted rows as new files: one run for level 0, disjoint key ranges for others.

        ``keys``: how many at most, for the size of Bloom filters; Parquet
        shrinks them to the keys it sees.
        """
        file_id = self.manifest.next_file_id
        path = f"{DATA}/run-{file_id:06d}"
        if clustered:
            parts = max(1, min(-(-size_hint // self.target_file_bytes), 10_000))
            rows = rows.repartitionByRange(parts, "key") if parts > 1 else rows.coalesce(1)
        writer = rows.select("key", "seq", "op", "value").sortWithinPartitions("key").write
        if self.bloom_keys:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, min(self.bloom_keys, keys or self.bloom_keys)))).option("parquet.bloom.filter.adaptive.enabled", "true")
        try:
            writer.parquet(self.storage.at(path))
            return self._describe(path, level, file_id, whole=level == 0)
        except BaseException:
            self.storage.delete(self.storage.at(path))  # nothing names the folder yet, and a retry writes it again
            raise

    def _describe(self, path: str, level: int, first_id: int, whole: bool) -> list[FileMeta]:
        """Metadata of a written folder: one entry for all of it, or one per file."""
        rows = self.spark.read.schema(ENTRY_SCHEMA).parquet(self.storage.at(path))
        name = F.lit("") if whole else F.col("_metadata.file_name")
        stats = rows.groupBy(name.alias("name")).agg(F.min("key"), F.max("key"), F.count("*"), F.max("seq")).orderBy("min(key)").collect()
        out = []
        for k, (file, low, high, n, seq) in enumerate(stats):
            own = f"{path}/{file}" if file else path
            out.append(FileMeta(first_id + k, level, bytes(low), bytes(high), n, self.storage.size(self.storage.at(own)), own, seq))
        return out

    def _commit(self, removed: Iterable[FileMeta], added: list[FileMeta], **numbers: Any) -> None:
        with self._lock:
            following = max([self.manifest.next_file_id, *(f.file_id + 1 for f in added)])
            manifest = self.manifest.replaced(removed, added, next_file_id=following, **numbers)
            self._manifests.commit(manifest)
            self.manifest = manifest

    def _rotate(self) -> list[tuple]:
        """Makes the buffer immutable, unless an older one still waits; the rows of the immutable one."""
        with self._lock:
            self._check()
            if self._immutable is None and len(self._buffer):
                self._immutable, self._buffer = self._buffer, WriteBuffer(self._buffer.capacity)
            return self._immutable.rows() if self._immutable else []

    def _drain(self) -> int:
        """Writes what is buffered now, an immutable buffer of an earlier failed flush first; returns its entries."""
        written = 0
        for _ in range(2 if self._immutable else 1):
            rows = self._rotate()
            if not rows:
                break
            frame = self.spark.createDataFrame([(bytearray(k), s, o, None if v is None else bytearray(v)) for k, s, o, v in rows], ENTRY_SCHEMA)
            files = self._store(frame.coalesce(1), 0, clustered=False, keys=len(rows))
            with self._lock:
                self._commit((), files)
                self._immutable = None
                if self._log:  # rows put since the rotation stay logged
                    self._log.rewrite((o, k, v or b"") for k, _, o, v in self._buffer.rows())
            self._counts["flushes"] += 1
            written += len(rows)
        return written

    def flush(self) -> int:
        """Writes the buffer as one run; returns its entries, tombstones included.  Puts and gets go on meanwhile."""
        with self._maintenance:
            written = self._drain()
        if written and self.auto_compact:
            self.maybe_compact()
        return written

    def sync(self) -> None:
        """Forces the log to disk; the buffer stays."""
        self._check()
        if self._log:
            self._log.sync()

    # --- reading

    def _read(self, files: list[FileMeta]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(*[self.storage.at(f.path) for f in files])

    def _find(self, manifest: Manifest, key: bytes) -> tuple[int, int, bytes | None] | None:
        """Newest stored (seq, op, value) of a key: files pruned by range, one per level from 1 on, then one filtered read."""
        candidates = [f for f in manifest.level(0) if f.contains(key)] + [f for n in range(1, manifest.num_levels) if (f := find_file(manifest.level(n), key))]
        self._counts["files_probed"] += len(candidates)
        self._counts["files_pruned"] += len(manifest.files) - len(candidates)
        best, ask = None, []
        for f in candidates:
            known, row = self.cache.get(f.file_id, key)
            if not known:
                ask.append(f)
            elif row and (best is None or row[0] > best[0]):
                best = row
        if ask:
            rows = self._read(ask).where(F.col("key") == F.lit(key)).select("seq", "op", "value", "_metadata.file_path").collect()
            for f in ask:
                own = max(((r[0], r[1], None if r[2] is None else bytes(r[2])) for r in rows if f"/{f.path}" in r[3]), default=None, key=lambda r: r[0])
                self.cache.put(f.file_id, key, own, len(own[2] or b"") if own else 0)
                if own and (best is None or own[0] > best[0]):
                    best = own
        return best

    def _newest(self, manifest: Manifest, held: tuple[int, int, bytes | None] | None, key: bytes) -> tuple[bool, bytes | None]:
        """The newer of a row in memory and what is stored; files are read only where they may hold a newer one."""
        if held and held[0] > manifest.max_seq:
            return True, held[2]
        found = self._find(manifest, key)
        return (True, held[2]) if held and (found is None or held[0] > found[0]) else (found is not None, found[2] if found else None)

    def get_entry(self, key: Any) -> tuple[bool, bytes | None]:
        wanted = to_bytes(key)
        with self._lock:
            self._check()
            self._counts["gets"] += 1
            held = self._buffer.row(wanted) or (self._immutable.row(wanted) if self._immutable else None)
            manifest = self.manifest
            if held and held[0] > manifest.max_seq:
                return True, held[2]
            self._reading.update(manifest.file_ids)
        try:
            return self._newest(manifest, held, wanted)
        finally:
            with self._lock:
                self._reading.subtract(manifest.file_ids)
                self._reading += Counter()  # drops what is no longer read
                self._collect()

    def get(self, key: Any) -> bytes | None:
        return self.get_entry(key)[1]

    def get_str(self, key: Any, encoding: str = "utf-8") -> str | None:
        value = self.get(key)
        return None if value is None else value.decode(encoding, errors="replace")

    def contains(self, key: Any) -> bool:
        return self.get(key) is not None

    def get_many(self, probes: DataFrame) -> DataFrame:
        """Live (key, value) of the keys of ``probes`` (key), by a semi-join before the merge; see :meth:`scan_frame`."""
        snap = self.snapshot()
        rows, _ = snap.rows()
        return self._held(scan.get_many(rows, probes.select(F.col("key").cast("binary").alias("key"))), snap)

    def _held(self, frame: DataFrame, snap: Snapshot) -> DataFrame:
        """Keeps the files of a lazy frame pinned for as long as the frame object lives."""
        weakref.finalize(frame, snap.close)
        return frame

    def snapshot(self) -> Snapshot:
        with self._lock:
            self._check()
            waiting = [r for r in self._immutable.rows() if r[0] not in self._buffer] if self._immutable else []
            snap = Snapshot(self, self._next_snapshot, self.manifest, [*waiting, *self._buffer.rows()])
            self._snapshots[snap.snapshot_id] = snap
            self._next_snapshot += 1
            return snap

    def scan(self, start: Any = None, end: Any = None) -> ScanCursor:
        """Live (key, value) by key, frozen at the call."""
        self._counts["scans"] += 1
        snap = self.snapshot()
        return ScanCursor(snap, snap.frame(start, end).orderBy("key"), owned=True)

    def keys(self, start: Any = None, end: Any = None) -> Iterator[bytes]:
        cursor = self.scan(start, end)
        return (k for k, _ in cursor)

    def scan_frame(self, start: Any = None, end: Any = None) -> DataFrame:
        """Live (key, value) as a DataFrame over the files of now, which stay while this frame object lives.

        What is derived from it does not hold them: keep the frame, or a
        snapshot, until that is computed.
        """
        self._counts["scans"] += 1
        snap = self.snapshot()
        return self._held(snap.frame(start, end), snap)

    def as_of(self, version: int) -> DataFrame:
        """Live (key, value) as an earlier manifest version had them; its files must still exist."""
        manifest = self._manifests.load(version)
        if lost := [f.path for f in manifest.files if not self.storage.exists(self.storage.at(f.path))]:
            raise InvalidArgumentError(f"version {version} is no longer stored: {lost}")
        return merge.current(self._read(list(manifest.files))).select("key", "value")

    # --- compaction and garbage

    def _run(self, task: planner.CompactionTask) -> None:
        rows = merge.compact(self._read(list(task.inputs)), task.drop_tombstones)
        added = self._store(rows, task.target_level, clustered=True, size_hint=task.input_bytes, keys=task.input_entries)
        with self._lock:
            self._commit(task.inputs, added)
            self._counts["compactions"] += 1
            self._counts["compacted_files"] += len(task.inputs)
            self._retire(task.inputs)

    def compact(self) -> bool:
        """One round, if one is due.  Puts and gets go on meanwhile."""
        with self._maintenance:
            self._check()
            task = planner.pick_task(self.manifest, self.l0_trigger, self.level_bytes, self.level_factor)
            if task:
                self._run(task)
            return task is not None

    def maybe_compact(self) -> int:
        """Rounds run, :data:`MAX_ROUNDS` at most."""
        rounds = 0
        while rounds < MAX_ROUNDS and self.compact():
            rounds += 1
        return rounds

    def compact_all(self) -> int:
        """Merges all stored files into the bottom level; returns their number.  The buffer stays, and takes puts meanwhile."""
        with self._maintenance:
            self._check()
            task = planner.plan_full(self.manifest)
            if task:
                self._run(task)
            return len(task.inputs) if task else 0

    @property
    def pinned_file_ids(self) -> set[int]:
        return {i for s in self._snapshots.values() for i in s.file_ids}

    def _retire(self, gone: Iterable[FileMeta]) -> None:
        self._pending |= {f.file_id: f for f in gone}
        self._collect()

    def _collect(self) -> None:
        pinned = self.pinned_file_ids | set(self._reading)
        for file_id, f in list(self._pending.items()):
            if file_id not in pinned:
                self.cache.evict_file(file_id)
                self.storage.delete(self.storage.at(f.path))
                del self._pending[file_id]

    def _release(self, snap: Snapshot) -> None:
        with self._lock:
            self._snapshots.pop(snap.snapshot_id, None)
            self._collect()

    # --- figures and closing

    def stats(self) -> TableStats:
        with self._lock:
            m, levels, cache = self.manifest, range(self.manifest.num_levels), self.cache.stats()
            return TableStats(
                version=m.version, buffer_entries=len(self._buffer), buffer_tombstones=self._buffer.tombstones, buffer_bytes=self._buffer.size, buffer_capacity=self._buffer.capacity,
                immutable_entries=len(self._immutable) if self._immutable else 0, log_rewrites=self._log.rewrites if self._log else 0, log_bytes=self._log.size if self._log else 0, file_count=len(m.files), stored_entries=sum(f.entry_count for f in m.files), stored_bytes=sum(f.size for f in m.files),
                level_files=tuple(len(m.level(n)) for n in levels), level_entries=tuple(sum(f.entry_count for f in m.level(n)) for n in levels), level_bytes=tuple(m.level_bytes(n) for n in levels),
                open_snapshots=len(self._snapshots), pinned_files=len(self.pinned_file_ids), pending_deletes=len(self._pending), recovered_records=len(self.recovery.records), recovery_truncated=self.recovery.truncated,
                cache_hits=cache.hits, cache_misses=cache.misses, cache_usage=cache.usage, **self._counts,
            )

    @property
    def num_levels(self) -> int:
        return self.manifest.num_levels

    @property
    def snapshot_count(self) -> int:
        return len(self._snapshots)

    def files_frame(self) -> DataFrame:
        return self.manifest.to_frame(self.spark)

    def close(self) -> None:
        """Forces the log to disk and ends all snapshots, after maintenance that runs; the buffer is not flushed.  Idempotent."""
        with self._maintenance, self._lock:
            if self.closed:
                return
            for snap in list(self._snapshots.values()):
                snap.closed = True
            self._snapshots.clear()
            self._collect()
            if self._log:
                self._log.sync()
                self._log.close()
            self.closed = True

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

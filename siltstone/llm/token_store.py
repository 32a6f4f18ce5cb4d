"""Content-addressed store of token ids.

Layout of a store, all of it Parquet:

``chunks``   (hash, ids): each distinct chunk of ids once, in buckets by hash;
             ``hash`` is the BLAKE2b-128 of ``ids``, which are little-endian
             numbers of ``width`` bytes.
``recipes``  one row per document in ascending order of id, part by part:
             (part, doc_id, copies, inside, n_tokens, root, chunks): its chunk
             hashes in order, their Merkle root, and the ids of its part
             before it; ``copies`` counts equal rows of the table.
``manifest`` one row per part of the recipes in order: (part, first_id,
             last_id, documents, n_tokens, root, width, buckets): Merkle roots
             over the roots of its documents.

Documents are cut where a rolling hash of the last ids has its low bits zero,
so equal passages give equal chunks wherever they stand.  Reading verifies
the manifest against the recipes, chunk hashes and document roots, and raises
where a chunk, a recipe or a part is missing, repeated or other than stated.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._runtime import Workspace, release
from siltstone.llm.tokens import encoder, slices

#: Ids the rolling hash looks at, least and most ids of a chunk, and the mean distance of cuts.
WINDOW, LEAST, MOST, MEAN = 16, 128, 2048, 512
#: Documents in a batch that reading gives on.
READ_DOCS = 128
#: A chunk in more documents than both is joined by broadcast; at most HOT_PARTS such chunks can exist.
HOT_DOCS, HOT_PARTS = 10_000, 5_000
#: Chunks that a task remembers to have given, so that a passage of many documents leaves each task once.
TASK_CHUNKS = 400_000
_RECIPES = "part int, doc_id long, copies long, inside long, n_tokens long, root binary, chunks array<binary>"
_MANIFEST = "part int, first_id long, last_id long, documents long, n_tokens long, root binary"

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, size=1 << 16, dtype=np.uint32)


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd one out goes up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        pairs = [digest(b"\x01" + a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


class MerkleStream:
    """:func:`merkle` of leaves that come one by one; holds one digest per level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = leaf
                return
            leaf, self.levels[k] = digest(b"\x01" + held + leaf), None
        self.levels.append(leaf)

    def root(self) -> bytes:
        out = None
        for held in self.levels:
            if held is not None:
                out = held if out is None else digest(b"\x01" + held + out)
        return digest(b"") if out is None else out


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last :data:`WINDOW` ids allows a cut.

    The hash of a window is the sum of each id's random number shifted by its
    age; windows double, so it takes log2(WINDOW) passes.  All ids of the
    window reach the top bits, which decide.
    """
    h = _GEAR[ids & 0xFFFF]
    span = 1
    while span < WINDOW:
        older = np.zeros_like(h)
        np.left_shift(h[:-span], np.uint32(span), out=older[span:])
        h += older
        span *= 2
    return np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1


def chunk_ends(marks: np.ndarray, first: int, last: int) -> list[int]:
    """Ends of the chunks of ids first to last, cut at marks, each LEAST to MOST long but for the last."""
    ends, at = [], first
    inner = marks[np.searchsorted(marks, first, "right") : np.searchsorted(marks, last, "left")].tolist()
    for mark in [*inner, last]:
        while mark - at > MOST:
            at += MOST
            ends.append(at)
        if mark - at >= LEAST or mark == last and mark > at:
            at = mark
            ends.append(at)
    return ends


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens, root, hashes, parts): every row with its chunks; a chunk that the task gave before is null."""
    kind = np.dtype(f"<u{width}")
    names = ["doc_id", "n_tokens", "root", "hashes", "parts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, given = encoder(tokenizer), end_id.to_bytes(4, "little"), set()
        for whole in batches:
            for at, n in slices(whole.column(1)):
                if len(given) > TASK_CHUNKS:
                    given.clear()
                batch = whole.slice(at, n)
                each_ids = [x + end for x in enc.encode([(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column(1)])]
                lengths = [len(x) // 4 for x in each_ids]
                ids = np.frombuffer(b"".join(each_ids), dtype="<u4")
                del each_ids
                raw, marks, begin = ids.astype(kind).tobytes(), cut_marks(ids), 0
                rows = []
                for doc, length in zip(batch.column(0).to_pylist(), lengths, strict=True):
                    bounds = [begin, *chunk_ends(marks, begin, begin + length)]
                    parts = [raw[a * width : b * width] for a, b in zip(bounds, bounds[1:], strict=False)]
                    hashes = [digest(p) for p in parts]
                    for k, h in enumerate(hashes):
                        if h in given:
                            parts[k] = None
                        given.add(h)
                    rows.append((doc, length, merkle(hashes), hashes, parts))
                    begin += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long, root binary, hashes array<binary>, parts array<binary>")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills ``inside`` of sorted recipes, a part a task: the ids of the part before each."""
    total = 0
    for batch in batches:
        n = np.array([c * t for c, t in zip(batch["copies"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True)], dtype=np.int64)
        ends = total + np.cumsum(n)
        at = batch.schema.get_field_index("inside")
        yield batch.set_column(at, batch.schema.field(at), pa.array(ends - n))
        total = int(ends[-1]) if len(ends) else total


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Manifest rows of recipes sorted by part and place; a place that does not continue the one before it spoils the root."""
    schema = pa.schema([("part", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
    held, tree = None, MerkleStream()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([held | {"root": tree.root()}], schema)

    for batch in batches:
        for part, doc, copies, inside, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held["part"] != part:
                if held is not None:
                    yield row()
                held, tree = {"part": part, "first_id": doc, "last_id": doc, "documents": 0, "n_tokens": 0}, MerkleStream()
            tree.add(root if inside == held["n_tokens"] else b"")
            held["last_id"] = doc
            held["documents"] += 1
            held["n_tokens"] += copies * n
    if held is not None:
        yield row()


class TokenStore:
    """A store at ``path``; ``table`` names the bucketed table of its chunks in the session's catalog."""

    def __init__(self, spark: SparkSession, path: str, width: int, table: str):
        self.spark, self.path, self.width, self.table = spark, path, width, table

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, vocabulary: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
        """Encodes every row's text, appends ``end_id`` and writes the store.

        A null or empty text is the end id alone.  Rows of equal id and ids are
        one recipe with its ``copies``; a null id comes first.  ``width`` is 2
        bytes for ids below 65,536, else 4.  Other columns are not read.
        Without ``path`` the store lasts as long as the process.
        """
        spark = docs.sparkSession
        path = path or Workspace(spark, "store").path
        width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
        work = Workspace(spark, "tokens")
        staged = work.stage(_encoded(docs, tokenizer, end_id, width, id_col, text_col), "encoded")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"siltstone_chunks_{uuid.uuid4().hex}"
        chunk = F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("parts").alias("ids"))).alias("c")
        once = staged.select(chunk).select("c.hash", "c.ids").where("ids IS NOT NULL").repartition(buckets, "hash").dropDuplicates(["hash"])
        once.write.bucketBy(buckets, "hash").option("path", f"{path}/chunks").option("compression", "zstd").saveAsTable(table)
        del once
        flat = staged.groupBy("doc_id", "root").agg(F.first("n_tokens").alias("n_tokens"), F.count("*").alias("copies"), F.first("hashes").alias("chunks"))
        ordered = flat.repartitionByRange(buckets, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
        names = [f.split()[0] for f in _RECIPES.split(", ")]
        rows = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "copies", F.lit(0).cast("long").alias("inside"), "n_tokens", "root", "chunks").select(*names)
        rows.mapInArrow(_running, _RECIPES).write.parquet(f"{path}/recipes")
        work.drop("encoded")
        release(spark)
        store = cls(spark, path, width, table)
        store._found_manifest().withColumns({"width": F.lit(width), "buckets": F.lit(buckets)}).coalesce(1).write.parquet(f"{path}/manifest")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenStore:
        """The store that was written to ``path``, in this or another session; raises where its manifest is missing."""
        row = spark.read.parquet(f"{path}/manifest").select("width", "buckets").first()
        width, buckets = row or (2, 1)
        table = f"siltstone_chunks_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {table} (hash BINARY, ids BINARY) USING parquet CLUSTERED BY (hash) INTO {buckets} BUCKETS LOCATION '{path}/chunks'")
        return cls(spark, path, width, table)

    def close(self) -> None:
        """Takes the table of chunks out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    @property
    def recipes(self) -> DataFrame:
        """The stored recipes with ``start``: the ids of all documents before each."""
        base, total = [], 0
        for r in self.manifest.orderBy("part").collect():  # a row a part
            base.append((r["part"], total))
            total += r["n_tokens"]
        bases = self.spark.createDataFrame(base, "part int, base long")
        return self._stored_recipes.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")

    @property
    def _stored_recipes(self) -> DataFrame:
        return self.spark.read.schema(_RECIPES).parquet(f"{self.path}/recipes")

    def _found_manifest(self) -> DataFrame:
        """Parts of the recipes and their Merkle roots, from a narrow pass over what is stored."""
        rows = self._stored_recipes.select("part", "doc_id", "copies", "inside", "n_tokens", "root")
        return rows.repartition("part").sortWithinPartitions("part", "inside", F.col("doc_id").asc_nulls_first()).mapInArrow(_part_rows, _MANIFEST)

    def verify_manifest(self) -> bool:
        """Whether the recipes have the parts, ids, counts and roots that the manifest states."""
        as_rows = lambda df: sorted(tuple(r) for r in df.withColumn("root", F.hex("root")).withColumns({c: F.coalesce(c, F.lit(-(1 << 63))) for c in ("first_id", "last_id")}).collect())
        return as_rows(self._found_manifest()) == as_rows(self.manifest)

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids: little-endian unsigned 32-bit numbers) of every document, put together again.

        Chunks stay where they are: they are bucketed by hash, and the recipes
        come to them and are hashed, so chunks are neither shuffled nor sorted.  A chunk that very many documents hold is broadcast
        instead.  Raises where a hash or a root does not fit.
        """
        if not self.verify_manifest():
            raise ValueError(f"the recipes in {self.path} are not those that its manifest states")
        refs = self.recipes.select("doc_id", "copies", "start", "n_tokens", "root", F.posexplode("chunks").alias("pos", "hash"))
        chunks = self.spark.table(self.table)
        total = refs.count()
        hot = refs.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_DOCS, total // HOT_PARTS)).select("hash")
        hot_chunks = F.broadcast(chunks.join(F.broadcast(hot), "hash", "left_semi"))
        usual = refs.join(F.broadcast(hot), "hash", "left_anti").join(chunks.hint("shuffle_hash"), "hash", "left")
        rows = usual.unionByName(refs.join(F.broadcast(hot), "hash", "left_semi").join(hot_chunks, "hash", "left")).select("start", "doc_id", "copies", "n_tokens", "root", "pos", "hash", "ids")
        kind = np.dtype(f"<u{self.width}")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, parts, hashes = None, [], []

            def row() -> tuple:
                start, doc, copies, n, root = key
                if merkle(hashes) != root or sum(map(len, parts)) != n * kind.itemsize:
                    raise ValueError(f"document {doc}: its chunks do not fit its root")
                return start, doc, copies, n, np.frombuffer(b"".join(parts), dtype=kind).astype("<u4").tobytes()

            def batch_of(rows: list[tuple]) -> pa.RecordBatch:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["start", "doc_id", "copies", "n_tokens", "ids"])

            done: list[tuple] = []
            for batch in batches:
                for start, doc, copies, n, root, _, name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if ids is None or digest(ids) != name:
                        raise ValueError(f"a chunk of document {doc} is missing or does not fit its hash")
                    if key is not None and key[0] != start:
                        done.append(row())
                        parts, hashes = [], []
                    key = (start, doc, copies, n, root)
                    parts.append(ids)
                    hashes.append(name)
                    if len(done) >= READ_DOCS:
                        yield batch_of(done)
                        done = []
            if key is not None:
                done.append(row())
            if done:
                yield batch_of(done)

        ordered = rows.repartition("start").sortWithinPartitions("start", "pos")
        found = ordered.mapInArrow(whole, "start long, doc_id long, copies long, n_tokens long, ids binary")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
        return found.withColumn("_k", every).select("doc_id", (F.col("start") + F.col("_k") * F.col("n_tokens")).alias("start"), "n_tokens", "ids")

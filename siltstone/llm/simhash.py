"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most r bits are cut into s
segments with s * 2 > r, so that at least one segment differs in at most one
bit.  Each segment is indexed once for each of its bits left out; equal
variants are the only candidates, and each candidate is verified.  There are
64 variants a fingerprint, whatever s is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._blocks import in_blocks, runs, spanning_links, together
from siltstone.llm._components import connected_components
from siltstone.llm._runtime import Workspace, few, spread

#: Seed of the XXH64 of a shingle.
SEED = 42
#: Members of a bucket that one unit of work compares at most, twice over.
BLOCK = 4096


def words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, A-Z in lower case."""
    return text.lower().split()


def shingles(tokens: list[bytes], width: int) -> list[bytes]:
    """Windows of ``width`` words joined by a space; of fewer words the whole sequence, of none nothing."""
    if not tokens:
        return []
    if len(tokens) <= width:
        return [b" ".join(tokens)]
    return [b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints (as rows of bytes, bit i of byte j in little order) from rows of hash bytes: bits set in over half."""
    total = np.zeros(hashes.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of a text, unsigned; 0 for a text without words."""
    parts = shingles(words(text or b""), width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in parts], dtype="<u8").view(np.uint8).reshape(-1, 8)
    return int(majority(hashes).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp long: the fingerprint's bits) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, "id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments, two at least, of which one differs in at most one bit."""
    count = max(2, max_bits // 2 + 1)
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(prints: DataFrame, fp: str, max_bits: int) -> DataFrame:
    """Rows of ``prints`` once per deletion variant: ``key`` has the segment, the bit left out and the other bits.

    The segment without the bit takes 31 bits at most (two segments) and the
    bit's place in the fingerprint, which names the segment too, 6 more, so
    keys are exact, not hashed.
    """
    column = F.col(fp)
    keys = []
    for first, bits in segments(max_bits):
        segment = F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << bits) - 1))
        keys += [
            F.shiftleft(segment.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << i))), 6).bitwiseOR(F.lit(first + i).cast("long")) for i in range(bits)
        ]
    return prints.withColumn("key", F.explode(F.array(*keys)))


def fingerprint_links(prints: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) that span every group within ``max_bits`` bits.

    Links are a spanning forest of each bucket, so their number is linear in
    the fingerprints; components over them are those over all links.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["key", "b1", "b2"]):
            fp = table["fp"].to_numpy().view(np.uint64)
            i, j = spanning_links(starts, lambda i, j, fp=fp: np.bitwise_count(fp[i] ^ fp[j]) <= max_bits)
            both = np.unique(np.stack([fp[i].view(np.int64), fp[j].view(np.int64)], axis=1), axis=0) if len(i) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    rows = in_blocks(variants(spread(prints.select("fp")), "fp", max_bits), "key", "fp", block)
    return together(rows.select("key", "b1", "b2", "fp"), "key").mapInArrow(each, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, block: int = BLOCK
) -> DataFrame:
    """(id_col, fingerprint: 16 hex digits, component_id) of every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is
    the least id reachable, itself included.  Copies share a fingerprint and
    enter the search once.  Null and empty texts and texts without words have
    fingerprint zero, linked like any other.  Repeated rows and repeated ids
    give one row each.  A null id keeps its fingerprint and never counts as
    the least; a group of null ids alone has a null component.  Other columns
    are not read.  Tables that grow with the rows are joined by merge, never
    by broadcast, whatever size Spark takes them for.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.stage(fingerprints(docs, id_col, text_col, width), "prints")
    classes = work.stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    links = work.stage(fingerprint_links(classes, max_bits, block), "links")
    roots = connected_components(links, work).withColumnRenamed("node", "fp")
    joined = classes.join(roots.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = work.stage(joined.join(least.hint("merge"), "root").select("fp", "component_id"), "groups")
    return prints.join(groups.hint("merge"), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Differing bits of fingerprints up to which sets are candidates for near duplicates.
PRINT_BITS = 3
#: Bands of BAND_ROWS MinHash values in which near duplicates with more differing bits are looked for: a pair of Jaccard similarity 0.8 shares one but for 3e-6.
BANDS, BAND_ROWS = 32, 5
#: Words of the sketch that rules pairs out before their sets are compared, and size below which a set counts as small for it.
SKETCH_WORDS, SMALL_SET = 4, 64
#: Members of a group of candidates whose sets one unit of work holds at most, twice over.
SET_BLOCK = 512
_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, size=2 * BANDS * BAND_ROWS + SKETCH_WORDS, dtype=np.uint64)
_ADD, _ODD, _SALT = _DRAWN[: BANDS * BAND_ROWS], _DRAWN[BANDS * BAND_ROWS : -SKETCH_WORDS] | np.uint64(1), _DRAWN[-SKETCH_WORDS:]


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the ``width``-word shingles of a text."""
    parts = shingles(words(text or b""), width)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in parts), dtype=np.uint64, count=len(parts)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(hashes: np.ndarray) -> list[int]:
    """Signed keys of the BANDS bands of a set; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 256):
        found = _mixed((hashes[at : at + 256, None] + _ADD) * _ODD)
        np.minimum(least, found.min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.array([xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64)
    return keys.view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set in SKETCH_WORDS * 64 bits, as SKETCH_WORDS signed numbers."""
    if not len(hashes):
        return np.zeros(SKETCH_WORDS, dtype=np.int64)
    return majority(_mixed(hashes[:, None] ^ _SALT).view(np.uint8).reshape(len(hashes), -1)).view(np.int64)


def sketch_bits(similarity: float) -> tuple[int, int]:
    """Differing sketch bits that sets of a Jaccard similarity of ``similarity`` or more do not exceed but for about one pair in a million.

    That is five standard deviations above the mean, of large sets (in which
    sets of one size differ most) and of sets below SMALL_SET, in which ties
    of the majority add to it.
    """
    n, share = 64 * SKETCH_WORDS, np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return tuple(int(np.ceil(n * p + 5 * np.sqrt(n * p * (1 - p)))) for p in (share, min(0.5, share + 0.05)))


def similar_sets(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as ascending distinct numbers, have a Jaccard similarity of ``similarity`` or more."""
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - 1e-9


def set_print(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set, signed; 0 for an empty set."""
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view("<i8")[0]) if len(hashes) else 0


def near_classes(docs: DataFrame, key: list, text_col: str, width: int) -> DataFrame:
    """(c1, c2, first, size, bands, fp, sketch words) of each distinct shingle set; ``first`` is the least ``key`` with it."""
    schema = "_k long, _t1 long, _t2 long, c1 long, c2 long, size int, bands array<long>, fp long, " + ", ".join(f"{c} long" for c in _SKETCH)
    names = ["_k", "_t1", "_t2", "c1", "c2", "size", "bands", "fp", *_SKETCH]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            whole, sizes, keys = np.empty((batch.num_rows, 2), np.int64), np.empty(batch.num_rows, np.int32), []
            found, prints = np.empty((batch.num_rows, SKETCH_WORDS), np.int64), np.empty(batch.num_rows, np.int64)
            for k, x in enumerate(batch.column(3)):
                hashes = shingle_set(x.as_py(), width)
                whole[k] = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype=np.int64)
                sizes[k], found[k], prints[k] = len(hashes), sketch(hashes), set_print(hashes)
                keys.append(bands(hashes))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(prints), *(pa.array(found[:, k]) for k in range(SKETCH_WORDS))], names
            )

    prints = docs.select(*key, F.col(text_col).cast("binary").alias("text")).mapInArrow(each, schema)
    first = F.min(F.struct("_k", "_t1", "_t2")).alias("first")
    return prints.groupBy("c1", "c2").agg(first, *[F.first(c).alias(c) for c in ("size", "bands", "fp", *_SKETCH)])


def _maybe(table: pa.Table, similarity: float):
    """A function of index arrays: which pairs of rows may be similar, by sizes and sketches."""
    large, small = sketch_bits(similarity)
    size = table["size"].to_numpy()
    words = np.stack([table[c].to_numpy().view(np.uint64) for c in _SKETCH], axis=1)

    def maybe(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        bits = np.bitwise_count(words[i] ^ words[j]).sum(axis=1)
        return (low >= similarity * high - 1e-9) & (bits <= np.where(low < SMALL_SET, small, large))

    return maybe


def _pairs(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([ids[i], ids[j]], axis=1), axis=0) if len(i) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def near_links(classes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of ids of ``classes`` that span, in each bucket of a band, what may be similar by sizes and sketches."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["key", "b1", "b2"]):
            yield _pairs(table["id"].to_numpy(), *spanning_links(starts, _maybe(table, similarity)))

    keyed = spread(classes.select("id", "bands")).select("id", F.explode("bands").alias("key"))
    rows = in_blocks(keyed, "key", "id", block).select("key", "b1", "b2", "id").join(classes.select("id", "size", *_SKETCH), "id")
    return together(rows, "key").mapInArrow(links, "a long, b long").distinct()


def print_links(classes: DataFrame, prints: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of ids of ``classes`` that keep together what has fingerprints within ``max_bits`` bits.

    ``prints`` is (fp, first): each fingerprint of ``classes`` once, with the least id that has it.
    """
    same = classes.select("id", "fp").join(prints, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    ends = [prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_id")) for c in ("a", "b")]
    near = fingerprint_links(prints, max_bits, block).join(ends[0], "a").join(ends[1], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return same.unionByName(near)


def exact_links(members: DataFrame, sets: DataFrame, similarity: float, block: int = SET_BLOCK) -> DataFrame:
    """Links (a, b) that span, in each ``component`` of ``members``, all pairs of sets of ``similarity`` or more.

    ``members`` is (component, id), ``sets`` (id, size, sketch words, hashes).
    Every pair of a component is decided, by its sets unless sizes or sketches rule it out.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(few(batches), ["component", "b1", "b2"]):
            maybe = _maybe(table, similarity)
            hashes = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]

            def near(i: np.ndarray, j: np.ndarray, maybe=maybe, hashes=hashes) -> np.ndarray:
                hit = maybe(i, j)
                at = np.flatnonzero(hit)
                hit[at] = [similar_sets(hashes[x], hashes[y], similarity) for x, y in zip(i[at], j[at], strict=True)]
                return hit

            yield _pairs(table["id"].to_numpy(), *spanning_links(starts, near))

    rows = in_blocks(members.select("component", "id"), "component", "id", block).select("component", "b1", "b2", "id").join(sets, "id")
    return together(rows, "component").mapInArrow(links, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, key: list, text_col: str, width: int, members: DataFrame) -> DataFrame:
    """``members`` (_k, _t1, _t2 of their text in ``docs``, id and more) once each with ``hashes``, the bytes of their shingle set."""
    names = [c for c in members.columns if c not in ("_k", "_t1", "_t2")]
    rows = docs.select(*key, F.col(text_col).cast("binary").alias("text")).join(members, ["_k", "_t1", "_t2"]).select("text", *names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", hashes binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = [shingle_set(x.as_py(), width).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], [*names, "hashes"])

    return rows.mapInArrow(each, schema).dropDuplicates(["id"])


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the least id.

    Candidates are found twice.  SimHash: fingerprints of the sets of
    ``width``-word shingles, deletion variants of their two segments, equality
    join, and :data:`PRINT_BITS` or fewer differing bits.  As many pairs of
    the similarity asked for differ in more bits, those that share a band of
    MinHash values and are not ruled out by sizes or sketches join them.  In each component
    of candidates the sets of every pair not ruled out are compared; a link is a pair with a
    Jaccard similarity of ``similarity`` or more.  Groups are components of
    links.  Repeated rows, and texts equal but for case and white space, are
    duplicates; null and empty texts and texts without words are duplicates of
    each other.  A null id comes before all others.  Other columns are kept.
    """
    work = Workspace(docs.sparkSession, "near")
    least = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_k")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [least, F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]
    classes = work.stage(near_classes(docs, key, text_col, width), "classes")
    classes = work.stage(classes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    prints = work.stage(classes.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    near = work.stage(print_links(classes, prints, PRINT_BITS, block), "near")
    maybe = work.stage(near_links(classes, similarity, block).unionByName(near).distinct(), "candidates")
    groups = connected_components(maybe, work, "groups").withColumnRenamed("node", "id")
    members = work.stage(classes.join(groups, "id").select("first.*", "id", "component", "size", *_SKETCH), "members")
    sets = work.stage(shingle_sets(docs, key, text_col, width, members.drop("component")), "sets")
    edges = work.stage(exact_links(members, sets, similarity, min(block, SET_BLOCK)), "links")
    work.drop("sets")
    roots = connected_components(edges, work).withColumnRenamed("node", "id")
    grouped = classes.join(roots, "id", "left").groupBy(F.coalesce("component", "id").alias("root"))
    winners = work.stage(grouped.agg(F.min("first").alias("f")).select("f.*"), "winners")
    keep = ["_k", "_t1", "_t2"]
    return docs.select("*", *key).join(winners, keep, "left_semi").dropDuplicates(keep).drop(*keep)

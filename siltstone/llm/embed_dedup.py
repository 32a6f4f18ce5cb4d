"""Embedding near-dedup by cross-polytope hashing.

A vector is rotated at random by three rounds of sign flips and a fast
Hadamard transform; its hash is the signed axis nearest to it.  A table
concatenates several such hashes, and a vector also looks into the buckets
that would have been next (multiprobe).  Vectors that share a bucket are
verified by their cosine in double precision.  Buckets give a spanning forest
of links; links are then counted exactly within each component, by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._blocks import in_blocks, runs, spanning_links, together
from siltstone.llm._components import connected_components
from siltstone.llm._runtime import Workspace

#: Tables, hashes concatenated in a table, buckets a vector enters in a table.
TABLES, HASHES, PROBES = 10, 2, 6
#: Members of a block.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def rotations(width: int, count: int, seed: int) -> np.ndarray:
    """Signs of three rounds for each of ``count`` rotations."""
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], size=(count, 3, width))


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """Bucket numbers (rows, tables, probes) of unit rows; the first probe is the vector's own bucket.

    Further probes swap one of the concatenated hashes for its next best axes,
    nearest first by the gap in the rotated coordinate.
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    signs = rotations(width, tables * hashes, seed)
    out = np.empty((n, tables, probes), dtype=np.int64)
    axes = min(2 * width, probes)
    for t in range(tables):
        best, gaps = [], []
        for h in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t * hashes + h, r]) / np.sqrt(width)
            both = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-both, axes - 1, axis=1)[:, :axes]
            value = np.take_along_axis(both, top, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            best.append(np.take_along_axis(top, order, axis=1))
            value = np.take_along_axis(value, order, axis=1)
            gaps.append(value[:, :1] - value)
        base = np.zeros(n, dtype=np.int64)
        for h in range(hashes):
            base = base * (2 * width) + best[h][:, 0]
        options, cost = [base], [np.full(n, -1.0)]
        for h in range(hashes):
            place = (2 * width) ** (hashes - 1 - h)
            for k in range(1, axes):
                options.append(base + (best[h][:, k] - best[h][:, 0]) * place)
                cost.append(gaps[h][:, k])
        cost, options = np.stack(cost, axis=1), np.stack(options, axis=1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(options, pick, axis=1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = base[:, None]
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths to rows of doubles."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x, axis=1)


def _near(x: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair of rows has a cosine of ``threshold`` or more."""
    norm = _units(x)
    return np.concatenate([(x[a : a + 512] @ x.T) / (norm[a : a + 512, None] * norm[None, :]) >= threshold for a in range(0, len(x), 512)])


def bucket_rows(classes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(key, id): each class (id, label, v) in each of its buckets; a key hashes label, length, table and bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = _matrix(pa.chunked_array([part.column(2)]))
                b = buckets(x / _units(x)[:, None], tables, hashes, probes)
                n = part.num_rows
                table = np.broadcast_to(np.arange(tables)[None, :, None], b.shape).reshape(-1)
                each_row = np.repeat(np.arange(n), tables * b.shape[2])
                take = lambda c, r=each_row: pa.array(c.to_numpy()[r])
                yield pa.RecordBatch.from_arrays([take(part.column(0)), take(part.column(1)), pa.array(np.full(len(table), size, dtype=np.int32)), pa.array(table.astype(np.int32)), pa.array(b.reshape(-1))], ["id", "label", "size", "table", "bucket"])

    rows = classes.select("id", "label", "v").mapInArrow(each, "id long, label long, size int, table int, bucket long")
    return rows.select(F.xxhash64("label", "size", "table", "bucket").alias("key"), "id").distinct()


def embedding_links(classes: DataFrame, threshold: float, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span what the tables find among classes (id, label, v)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["key", "b1", "b2"]):
            ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
            sizes = np.asarray(table["v"].combine_chunks().value_lengths())
            first = np.r_[0, np.cumsum(sizes)][:-1]
            flat = table["v"].combine_chunks().flatten().to_numpy().astype(np.float64)

            def near(i: np.ndarray, j: np.ndarray, sizes=sizes, first=first, flat=flat, labels=labels) -> np.ndarray:
                hit = (sizes[i] == sizes[j]) & (labels[i] == labels[j])
                for size in np.unique(sizes[i[hit]]):
                    at = np.flatnonzero(hit & (sizes[i] == size))
                    span = np.arange(size)
                    for k in range(0, len(at), 1 << 15):
                        part = at[k : k + (1 << 15)]
                        u, v = flat[first[i[part]][:, None] + span], flat[first[j[part]][:, None] + span]
                        hit[part] = np.einsum("ij,ij->i", u, v) / (_units(u) * _units(v)) >= threshold
                return hit

            def matrix(a: int, b: int, sizes=sizes, first=first, flat=flat, labels=labels) -> np.ndarray | None:
                if (sizes[a:b] != sizes[a]).any():
                    return None
                x = flat[first[a] : first[a] + (b - a) * sizes[a]].reshape(b - a, -1)
                return _near(x, threshold) & (labels[a:b][:, None] == labels[a:b][None, :])

            i, j = spanning_links(starts, near, matrix)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    rows = in_blocks(bucket_rows(classes, tables, hashes, probes), "key", "id", block)
    with_v = rows.select("key", "b1", "b2", "id").join(classes.select("id", "label", "v"), "id")
    return together(with_v, "key").mapInArrow(each, "a long, b long").distinct()


def link_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Members (component, id, v, copies) to (id, n): copies of the others of the component within ``threshold``.

    Each pair of blocks of a component is one matrix product; no pair is a row.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["component", "b1", "b2"]):
            ids, own, b1, b2, copies = (table[c].to_numpy() for c in ("id", "own", "b1", "b2", "copies"))
            total = np.zeros(len(ids), dtype=np.int64)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                near = _near(_matrix(table["v"].slice(a, b - a)), threshold)
                np.fill_diagonal(near, False)
                if b1[a] != b2[a]:
                    near &= own[a:b][:, None] != own[a:b][None, :]
                total[a:b] = near @ copies[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

    rows = in_blocks(members.select("component", "id"), "component", "id", block).join(members.select("id", "v", "copies"), "id")
    return together(rows, "component").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def dedup_embeddings(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``vectors``: id_col, n_links, component_id, kept.

    Rows are compared only with rows of the same label and length, by cosine
    in double precision.  Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a label or id, link with nothing:
    n_links 0, component_id their own id, kept.  Equal vectors of a label are
    one class, searched once, and count as links of each other.  Repeated ids
    give one row each.  ``hashes`` should grow with the logarithm of the rows
    of a label; block pairs keep any bucket whole.
    """
    work = Workspace(vectors.sparkSession, "embeddings")
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    sound = sound & F.exists(v, lambda e: e != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    good = rows.where("sound").drop("sound")
    equal = work.stage(good.groupBy("label", "v").agg(F.min("vec").alias("first"), F.count("*").alias("copies")), "equal")
    classes = work.stage(equal.withColumn("id", F.monotonically_increasing_id()), "classes")
    links = work.stage(embedding_links(classes, threshold, tables, hashes, probes, block), "links")
    roots = work.stage(connected_components(links, work).withColumnRenamed("node", "id"), "roots")
    members = work.stage(classes.join(roots, "id").select("component", "id", "v", "copies", "first"), "members")
    counts = link_counts(members.drop("first"), threshold, block)
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    linked = members.select("id", "component").join(least, "component").join(counts, "id", "left")
    found = classes.join(linked.select("id", "least", "n"), "id", "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")
    )
    judged = good.join(work.stage(found, "found"), ["label", "v"]).select("vec", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    kept = F.coalesce(F.col("vec") == F.col("component_id"), F.lit(True))
    return judged.unionByName(alone).select(F.col("vec").alias(id_col), "n_links", "component_id", kept.alias("kept"))

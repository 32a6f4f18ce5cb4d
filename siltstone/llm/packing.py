"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are encoded, cut into pieces of at most ``capacity`` tokens, and the
pieces packed into as few sequences as the search finds.  A full piece is a
sequence of its own.  The others are dealt at random into groups of bounded
size.  Each group is solved on several islands: a small population of packings,
where crossover injects whole well-filled bins of one parent into another,
removes the bins that held the same pieces, and best-fits the displaced ones.
After an epoch each island's elite migrates to the next island of its group.
A group whose packing meets the lower bound stops at once.  The emptiest bins
of all groups are then packed again in fewer groups, until one is left.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._runtime import Workspace
from siltstone.llm.tokens import encoder, slices

#: Pieces in a group, in the mean.
GROUP_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12
#: Emptiest bins of each group that the next round packs again.
LOOSE_BINS = 4

PIECES = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"


def piece_rows(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (see :data:`PIECES`) of every row; ``uid`` is a number of the row, so repeated ids stay apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for whole in batches:
            for at, n in slices(whole.column(2)):
                batch = whole.slice(at, n)
                texts = [(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(2)]
                rows = []
                for doc, uid, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), enc.encode(texts), strict=True):
                    ids, step = ids + end, 4 * capacity
                    rows += [(doc, uid, k, b // 4, (min(b + step, len(ids)) - b) // 4, zlib.crc32(ids[b : b + step])) for k, b in enumerate(range(0, len(ids), step))]
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], PIECES.replace(",", "").split()[::2])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, PIECES)


@dataclass
class Packing:
    """Bins of item numbers and their fills."""

    bins: list[list[int]] = field(default_factory=list)
    fills: list[int] = field(default_factory=list)

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: larger is better."""
        return (-len(self.bins), sum((f / capacity) ** 2 for f in self.fills))


def best_fit(packing: Packing, items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Puts ``items``, largest first, each into the fullest bin that takes it, or a new one.

    Bins are kept by free room; a bit set of the rooms in use gives the
    smallest that is large enough in a few machine operations.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for b, fill in enumerate(packing.fills):
        rooms[capacity - fill].append(b)
        used |= 1 << (capacity - fill)
    for item in sorted(items, key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
            packing.bins[b].append(item)
            packing.fills[b] += size
        else:
            room, b = capacity, len(packing.bins)
            packing.bins.append([item])
            packing.fills.append(size)
        rooms[room - size].append(b)
        used |= 1 << (room - size)
    return packing


def crossover(base: Packing, donor: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects whole well-filled bins of ``donor``, drops the bins of ``base`` that share a piece, best-fits what they held besides."""
    order = sorted(range(len(donor.bins)), key=lambda b: -donor.fills[b])
    take = order[: max(1, int(len(order) * rng.uniform(0.2, 0.6)))]
    taken = {i for b in take for i in donor.bins[b]}
    child, displaced = Packing([list(donor.bins[b]) for b in take], [donor.fills[b] for b in take]), []
    for items, fill in zip(base.bins, base.fills, strict=True):
        if taken.isdisjoint(items):
            child.bins.append(list(items))
            child.fills.append(fill)
        else:
            displaced += [i for i in items if i not in taken]
    return best_fit(child, displaced, sizes, capacity)


def mutate(packing: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empties the loosest bin and a few others at random and best-fits their pieces."""
    loosest = min(range(len(packing.bins)), key=lambda b: packing.fills[b])
    out = {loosest, *rng.sample(range(len(packing.bins)), min(len(packing.bins), 1 + len(packing.bins) // 20))}
    kept = [b for b in range(len(packing.bins)) if b not in out]
    child = Packing([list(packing.bins[b]) for b in kept], [packing.fills[b] for b in kept])
    loose = [i for b in out for i in packing.bins[b]]
    rng.shuffle(loose)
    return best_fit(child, loose, sizes, capacity)


def evolve(sizes: list[int], capacity: int, population: list[Packing], rng: random.Random, generations: int = GENERATIONS) -> Packing:
    """The best packing found from ``population`` and fresh best-fit ones; stops at the lower bound."""
    bound = -(-sum(sizes) // capacity)
    rank = lambda p: p.fitness(capacity)
    if not sizes:
        return Packing()
    if not population:
        population = [best_fit(Packing(), list(range(len(sizes))), sizes, capacity)]
    best = max(population, key=rank)
    if len(best.bins) <= bound:
        return best
    while len(population) < POPULATION:  # best-fit after a random part was placed first
        first = rng.sample(range(len(sizes)), len(sizes) // 4)
        chosen = set(first)
        start = best_fit(Packing(), first, sizes, capacity)
        population.append(best_fit(start, [i for i in range(len(sizes)) if i not in chosen], sizes, capacity))
    for _ in range(generations):
        a, b = rng.sample(population, 2)
        child = crossover(a, b, sizes, capacity, rng)
        if rng.random() < 0.7:
            child = mutate(child, sizes, capacity, rng)
        worst = min(range(len(population)), key=lambda k: rank(population[k]))
        if rank(child) >= rank(population[worst]):
            population[worst] = child
        best = max(population, key=rank)
        if len(best.bins) <= bound:
            break
    return best


def _packing_of(bins: np.ndarray, sizes: list[int]) -> Packing | None:
    """A packing from a bin number per item; None where there is none yet."""
    if len(bins) == 0 or bins[0] < 0:
        return None
    out = Packing([[] for _ in range(int(bins.max()) + 1)], [0] * (int(bins.max()) + 1))
    for i, b in enumerate(bins.tolist()):
        out.bins[b].append(i)
        out.fills[b] += sizes[i]
    return out


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("uid", "ascending"), ("piece", "ascending")])


_ISLAND = "g long, island int, uid long, piece int, length long, own int, guest int, n_bins long, squares double"


def _solve_island(capacity: int):
    def solve(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        sizes = table["length"].to_pylist()
        g, island = table["g"][0].as_py(), table["island"][0].as_py()
        elites = [p for p in (_packing_of(table[c].to_numpy(), sizes) for c in ("own", "guest")) if p]
        best = evolve(sizes, capacity, elites, random.Random(1_000_003 * g + island + 7 * len(elites)))
        own = np.empty(len(sizes), dtype=np.int32)
        for b, items in enumerate(best.bins):
            own[items] = b
        fit = best.fitness(capacity)
        n = len(sizes)
        return pa.table(
            {"g": table["g"], "island": table["island"], "uid": table["uid"], "piece": table["piece"], "length": table["length"], "own": pa.array(own), "guest": pa.array(np.full(n, -1, dtype=np.int32)), "n_bins": pa.array([-fit[0]] * n, pa.int64()), "squares": pa.array([fit[1]] * n)}
        )

    return solve


def _migrate(solved: DataFrame, islands: int) -> DataFrame:
    """Each island's packing goes to the next island of its group as the guest."""
    guests = solved.select("g", "uid", "piece", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("own").alias("guest"))
    return solved.drop("guest").join(guests, ["g", "island", "uid", "piece"]).select(*[x.split()[0] for x in _ISLAND.split(", ")])


_PLACED = "g long, uid long, piece int, length long, bin int, offset long, loose boolean"


def _choose(loose_bins: int):
    """The best island's packing of a group, with offsets and the emptiest bins marked."""

    def choose(table: pa.Table) -> pa.Table:
        islands, bins, squares = (table[c].to_numpy() for c in ("island", "n_bins", "squares"))
        at = np.lexsort((islands, -squares, bins))[0]
        table = _sorted(table.filter(pa.array(islands == islands[at])))
        own, length = table["own"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(length[order])
        firsts = np.r_[True, own[order][1:] != own[order][:-1]]
        base = np.maximum.accumulate(np.where(firsts, ends - length[order], 0))
        offset = np.empty(len(own), dtype=np.int64)
        offset[order] = ends - length[order] - base
        fills = np.bincount(own, weights=length)
        loose = np.isin(own, np.argsort(fills, kind="stable")[:loose_bins])
        return pa.table({"g": table["g"], "uid": table["uid"], "piece": table["piece"], "length": table["length"], "bin": table["own"], "offset": pa.array(offset), "loose": pa.array(loose)})

    return choose


def pack_items(items: DataFrame, capacity: int, work: Workspace, group_items: int = GROUP_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, loose_bins: int = LOOSE_BINS) -> DataFrame:
    """(uid, piece, length <= capacity) to (uid, piece, sequence_id, offset)."""
    placed, level = [], 0
    total = items.count()
    while total:
        groups = -(-total // group_items)
        dealt = items.select(F.pmod(F.xxhash64("uid", "piece", F.lit(level)), F.lit(groups)).alias("g"), "uid", "piece", "length")
        none = F.lit(-1).cast("int")
        state = dealt.select(
            "g", F.explode(F.array(*[F.lit(k).cast("int") for k in range(islands)])).alias("island"), "uid", "piece", "length", none.alias("own"), none.alias("guest"), F.lit(0).cast("long").alias("n_bins"), F.lit(0.0).alias("squares")
        )
        for epoch in range(epochs):
            state = work.stage(state.groupBy("g", "island").applyInArrow(_solve_island(capacity), _ISLAND), f"level{level}-epoch{epoch}")
            if epoch + 1 < epochs:
                state = _migrate(state, islands)
        last = groups == 1
        best = work.stage(state.groupBy("g").applyInArrow(_choose(0 if last else loose_bins), _PLACED), f"level{level}")
        placed.append(best.where("NOT loose").select("uid", "piece", (F.lit(level).cast("long") * (1 << 56) + F.col("g") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        items = best.where("loose").select("uid", "piece", "length")
        total, level = items.count(), level + 1
    out = placed[0] if placed else items.select("uid", "piece", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end_id``; only a document longer than
    ``capacity`` is cut.  Sequences are at most ``capacity`` long and gapless
    from offset 0.  A null or empty text is the end id alone.  Repeated rows
    and ids are packed each on its own; a null id stays null; an empty table
    gives no rows; other columns are not read.
    """
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.stage(piece_rows(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    part = pack_items(pieces.where(F.col("length") < capacity).select("uid", "piece", "length"), capacity, work, **search)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    joined = pieces.where(F.col("length") < capacity).join(part, ["uid", "piece"]).select(*names)
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return joined.unionByName(full.select(*names)).withColumnRenamed("doc_id", id_col)

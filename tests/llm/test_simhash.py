from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_components_blocks import brute

from siltstone.llm import _components, simhash
from siltstone.llm._runtime import Workspace

SCHEMA = "doc_id long, text string, fp string"


def plain_print(text, width=3):
    """The contract, bit by bit."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    parts = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def documents():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(40)]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    rows += [(100 + k, t.replace(" w", " W", 3) + " end", None) for k, t in enumerate(texts[:15])]  # near copies
    rows += [(200 + k, texts[0], "x") for k in range(30)]  # exact copies
    rows += [(300, None, "x"), (301, "", "x"), (302, " \n\t", "x"), (303, "One", "x"), (304, "one two", "x"), (305, "É é ÀB", "x"), (306, "a b c d", "x")]
    rows += [(307, "long " * 30_000, "x"), (3, texts[3], "again"), (None, texts[4], "x")]
    return rows


@pytest.mark.parametrize("block", [4096, 5])
def test_components_equal_brute_force(spark, block):
    rows = documents()
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert len(got) == len(rows)
    prints = [(r[0], plain_print(r[1])) for r in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for i, p in prints)
    kinds = sorted({p for _, p in prints})
    roots = brute([(a, b) for a in kinds for b in kinds if (a ^ b).bit_count() <= 3])
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    by_print = {p: least[roots[p]] for _, p in prints}
    assert all(r.component_id == by_print[int(r.fingerprint, 16)] for r in got)


def test_no_rows(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 5, 7])
def test_one_segment_differs_by_at_most_one_bit(spark, bits):
    parts = simhash.segments(bits)
    assert sum(n for _, n in parts) == 64
    rng = np.random.default_rng(bits)
    pairs = []
    for _ in range(50):
        a, flips = int(rng.integers(0, 1 << 63)), rng.choice(64, size=bits, replace=False)
        pairs.append((a, a ^ sum(1 << int(f) for f in flips)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(k, side, signed(p[side])) for k, p in enumerate(pairs) for side in (0, 1)], "pair int, side int, fp long")
    keys = {}
    for r in simhash.variants(frame, "fp", bits).collect():
        keys.setdefault((r.pair, r.side), set()).add(r.key)
    assert all(len(keys[k, 0]) == 64 and keys[k, 0] & keys[k, 1] for k in range(len(pairs)))


def test_variants_are_not_broadcast(spark):
    """64 variants a fingerprint count as one row in Spark's estimate."""
    prints = spark.range(300).select(F.expr("xxhash64(id div 3) ^ shiftleft(1L, cast(id % 3 AS int))").alias("fp"))
    links = simhash.fingerprint_links(prints, 3)
    roots = brute([(r.a, r.b) for r in links.collect()])
    assert len(roots) == 300 and len(set(roots.values())) == 100
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_no_step_broadcasts(spark, monkeypatch):
    """Final plans of all steps, which adaptive execution may have turned to broadcasts."""
    plans, stage = [], Workspace.stage

    def run(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    def recorded(self, df, name):
        run(df)
        return stage(self, df, name)

    monkeypatch.setattr(Workspace, "stage", recorded)
    monkeypatch.setattr(_components, "FEW_EDGES", 0, raising=False)
    rows = documents()
    got = run(simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == len(rows) and len({r.component_id for r in got}) < len({r.fingerprint for r in got})
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_near_duplicates_by_five_words(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [list(rng.choice(vocabulary, 300)) for _ in range(30)]
    rows = [(k, " ".join(w), None) for k, w in enumerate(base)]
    for k in range(12):  # two of 300 words changed: similarity about 0.94
        near = list(base[k])
        for at in rng.choice(300, 2, replace=False):
            near[at] = "changed"
        rows.append((100 + k, " ".join(near), None))
    for k in range(12):  # 40 words changed: far below 0.8
        far = list(base[k])
        for at in rng.choice(300, 40, replace=False):
            far[at] = f"other{at}"
        rows.append((200 + k, " ".join(far), None))
    rows += [(5, rows[5][1], None), (400, rows[6][1].upper(), None), (401, None, None), (402, "", None), (None, "alone " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert len(kept) == len(set(kept))
    assert set(range(30)) | set(range(200, 212)) | {401, None} <= set(kept)
    assert len([k for k in kept if k is not None and 100 <= k < 112]) <= 1 and 400 not in kept and 402 not in kept
    assert simhash.drop_near_duplicates(docs.limit(0)).columns == docs.columns


def jaccard(a, b, width=5):
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def contiguous_edits():
    """(base, edited) texts: a passage added at the end or cut at the start or the middle, or scattered words changed."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(4000)]
    out = []
    for k in range(240):
        n = int(rng.integers(100, 900))
        base = list(rng.choice(vocabulary, n))
        part = int(n * rng.uniform(0.04, 0.19))
        at = int(rng.integers(0, n - part))
        edited = [base + list(rng.choice(vocabulary, part)), base[part:], base[:at] + base[at + part :], list(base)][k % 4]
        if k % 4 == 3:
            for i in rng.choice(n, max(1, part // 8), replace=False):
                edited[i] = "changed"
        out.append((" ".join(base), " ".join(edited)))
    return [p for p in out if jaccard(*p) >= 0.8]


def test_candidates_hold_every_contiguous_edit(spark):
    pairs = contiguous_edits()
    assert len(pairs) > 180 and sum(jaccard(*p) < 0.9 for p in pairs) > 60
    shared = [set(simhash.bands(simhash.shingle_set(a.encode()))) & set(simhash.bands(simhash.shingle_set(b.encode()))) for a, b in pairs]
    assert all(shared)


@pytest.mark.parametrize("block", [512, 3])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(40):  # variants of one text on both sides of 0.8
        base = list(rng.choice(vocabulary, int(rng.integers(20, 300))))
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 6, 7, 8):
            near = list(base)
            for at in rng.choice(len(base), min(changes, len(base) // 5), replace=False):
                near[at] = "changed"
            texts.append(" ".join(near))
        texts.append(" ".join(base[: int(len(base) * 0.83)]))
    texts += [p for pair in contiguous_edits()[:60] for p in pair]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, block=block).collect()}
    parts = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    share = {(a, b): len(parts[a] & parts[b]) / len(parts[a] | parts[b]) for a in range(len(parts)) for b in range(a, len(parts))}
    assert sum(0.7 <= s < 0.8 for s in share.values()) > 30 < sum(0.8 <= s < 0.87 for s in share.values())
    assert all(simhash.similar_sets(sets[a], sets[b], 0.8) == (s >= 0.8) for (a, b), s in share.items() if s > 0.5)
    roots = brute([p for p, s in share.items() if s >= 0.8])
    assert kept == {k for k in range(len(texts)) if roots[k] == k}


def test_fingerprints_give_candidates_without_bands(spark, monkeypatch):
    """Near duplicates within three bits go by deletion variants and the exact check alone; similar fingerprints alone drop nothing."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [list(rng.choice(vocabulary, 1500)) for _ in range(12)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:700], "changed", *w[701:]]) for w in base]
    texts += [texts[0] + " " + texts[0], None, ""]
    prints = [simhash.set_print(simhash.shingle_set((t or "").encode())) & (1 << 64) - 1 for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert len([p for p in links if p[0] - p[1] == 12]) > 6  # most of the near copies, no other but 0 and its double, null and empty
    monkeypatch.setattr(simhash, "near_links", lambda classes, similarity, block: classes.select("id", "id").toDF("a", "b").limit(0))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    roots = brute([*links, *((k, k) for k in range(len(texts)))])
    assert kept == {k for k in range(len(texts)) if roots[k] == k}

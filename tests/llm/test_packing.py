from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing
from siltstone.llm.packing import Packing, best_fit, crossover, evolve, mutate
from siltstone.llm.tokens import Encoder, tokenizer_path

WORD = tokenizer_path("word_bpe_49k.json")


def valid(p, sizes, capacity):
    assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) == f <= capacity for b, f in zip(p.bins, p.fills, strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_search_keeps_packings_whole_and_improves(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(20, 70) for _ in range(120)]
    start = best_fit(Packing(), list(range(120)), sizes, 100)
    other = best_fit(Packing(), rng.sample(range(120), 120), sizes, 100)
    valid(start, sizes, 100)
    for _ in range(10):
        child = mutate(crossover(start, other, sizes, 100, rng), sizes, 100, rng)
        valid(child, sizes, 100)
        other = child
    found = evolve(sizes, 100, [start, other], rng, generations=40)
    valid(found, sizes, 100)
    assert found.fitness(100) >= start.fitness(100)
    assert evolve([], 100, [], rng).bins == []


def test_best_fit_takes_the_fullest_bin_that_fits():
    p = best_fit(Packing([[0], [1], [2]], [50, 70, 60]), [3], [50, 70, 60, 30], 100)
    assert p.bins[1] == [1, 3]


def test_crossover_keeps_injected_bins():
    sizes = [60, 40, 50, 50, 30, 30]
    donor = Packing([[0, 1], [2, 3], [4, 5]], [100, 100, 60])
    base = Packing([[0, 4], [1, 2], [3, 5]], [90, 90, 80])
    child = crossover(base, donor, sizes, 100, random.Random(0))
    valid(child, sizes, 100)
    assert [0, 1] in child.bins


@pytest.mark.parametrize("group", [4096, 8])
def test_pieces_and_sequences(spark, group):
    texts = [None, "", "Hello, WORLD's 12!", "a " * 300, " \n\n x　y", "b " * 64 + "c", "é" * 50] + [f"word{k} " * (k % 40) for k in range(60)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, "null id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = packing.pack_documents(docs, WORD, capacity=128, end_id=0, group_items=group, loose_bins=2).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = []
    for doc, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(str(doc), k, at, len(ids[at : at + 128]), zlib.crc32(np.array(ids[at : at + 128], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 128))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= -(-sum(r.length for r in got) // 128) + 2
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_islands_exchange_elites(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(k, 0, rng.randrange(30, 60)) for k in range(200)], "uid long, piece int, length long")
    from siltstone.llm._runtime import Workspace

    for islands, epochs in ((1, 1), (3, 3)):
        got = packing.pack_items(items, 100, Workspace(spark, "test"), group_items=64, islands=islands, epochs=epochs).collect()
        assert sorted(r.uid for r in got) == list(range(200))
        fills = {}
        length = {r.uid: r.length for r in items.collect()}
        for r in got:
            fills[r.sequence_id] = fills.get(r.sequence_id, 0) + length[r.uid]
        assert max(fills.values()) <= 100


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_gives_the_ids_of_the_library(name):
    path = tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    texts = ["a  b", "\n\n x\ty ", "don't  can't!! \n\n\nhi it's.", "", "   ", "x　 y", "é é́ oḱ,", "ΑΣ ΟΔΟΣ. ΣΑΣ", "#$%&|<> 12 345", "a\r\nb  \r\n c", "emoji 😀😀 \n 😀", "<|endoftext|> z", "a, b<|startoftext|>c. d <|ENDOFTEXT|>", "<|endoftext", "Wörter, Straße. naïve×÷ ǅ", "x" * 100 + " " + "y" * 60, "a.b,c;d:e!f?g", "foo!bar 'tis 'll", "\x85a\x1cb\x0bc", "ends with word"]
    for memo in (5, 1000):
        encoder = Encoder(path, memo_entries=memo)
        for _ in range(2):
            assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]

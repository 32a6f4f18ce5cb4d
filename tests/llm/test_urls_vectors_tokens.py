from __future__ import annotations

import os
import random
import shutil
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_components_blocks import brute
from tokenizers import Tokenizer

from siltstone.llm import embed_dedup, token_store, url_filter
from siltstone.llm._runtime import Workspace
from siltstone.llm.queries import URL_RULES
from siltstone.llm.tokens import tokenizer_path

BYTE = tokenizer_path("byte_bpe_50k.json")


# --- urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "a://example.com/en/", "a://notexample.com/en/", "a://example.com", "a://x.com?u=http://y.net/es/", "a://b.net#/es/", "a://b.net/es/1?q#f", "a://NET/fr/\n2", "x\ny://É.Net/es/", "a://www.example.com/fr/", "a://example.comx/en/", "a://com/", "a://://q.net/es/", "a://h.org/" + "p" * 100_000]
    pages = spark.createDataFrame([(k, u, None, "clash") for k, u in enumerate(urls)] + [(1, "", "<a", "x"), (None, "a://z.com/", None, "x")], "page_id long, url string, html string, host string")
    got = url_filter.filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[r.page_id] if r.page_id is not None else "a://z.com/"
        host, path = plain_url(url)
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.pattern if rule else None)
        assert r.verdict == rule.action if rule else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def dense_rank(edges, seeds, hosts, damping=0.85, steps=200):
    at = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for s, d, n in edges:
        w[at[d], at[s]] += n
    total = w.sum(axis=0)
    w = w / np.where(total > 0, total, 1)
    v = np.zeros(len(hosts))
    for h, x in seeds.items():
        v[at[h]] = x
    r = v * (1 - damping)
    for _ in range(steps):
        r = v * (1 - damping) + damping * (w @ r + v / v.sum() * r[total == 0].sum())  # hosts without links pass on to the seeds
    return {h: r[at[h]] for h in hosts}


def test_propagation_equals_dense_pagerank(spark):
    rng = random.Random(3)
    hosts = [f"h{k}" for k in range(15)]
    edges = {(rng.choice(hosts), "hub" if rng.random() < 0.3 else rng.choice(hosts)): rng.randrange(1, 5) for _ in range(50)}
    rows = [("trust", s, d, n) for (s, d), n in edges.items() if s != d]
    links = spark.createDataFrame(rows, "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "h1", 0.75), ("trust", "h2", 0.25)], "kind string, host string, seed double")
    got = {r.host: r.score for r in url_filter.propagate(links, seeds, Workspace(spark, "test"), tolerance=1e-9, hub_links=3).collect()}
    want = dense_rank([r[1:] for r in rows], {"h1": 0.75, "h2": 0.25}, [*hosts, "hub"])
    assert all(abs(got.get(h, 0.0) - want[h]) < 1e-6 for h in want)


def test_many_trusted_seeds_do_not_weaken_trust(spark):
    """One blocked seed and twenty trusted ones: a host that ten trusted links reach is not blocked for one link to the blocked host."""

    def page(host, path, *to):
        return f"http://{host}{path}", "".join(f'<a href="http://{h}/">' for h in to)

    rows = [page(f"t{k}.com", "/", "good.org", *(f"other{k}-{j}.org" for j in range(9))) for k in range(20)]
    rows += [page("x.net", "/es/1", "nowhere.org"), page("good.org", "/", "x.net"), page("bad.org", "/", "x.net")]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert got["good.org"].verdict == "allow" and got["good.org"].distrust > 0
    assert got["bad.org"].verdict == "block" and got["x.net"].verdict == "block"


def test_trust_and_distrust_reach_hosts_without_rules(spark):
    def link(*to):
        return "".join(f'<a href="{x}">x</a><A class=b HREF = \'{x}\'>' for x in to)

    pages = [
        (1, "http://good.com/", link("http://friend.org/a", "/relative", "//Cdn.org/x")),
        (2, "http://bad.net/es/", link("http://victim.org/")),
        (3, "http://friend.org/", ""),
        (4, "http://shady.org/", link("http://bad.net/es/", "http://friend.org/?x=http://bad.net/")),
        (5, "http://victim.org/", None),
        (6, "http://cdn.org/", "<p>http://bad.net/</p>"),
        (7, "http://far.org/", link("http://shady.org/p")),
    ]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "block"}
    assert got[3].trust > 0 and got[4].distrust > got[7].distrust > 0 and got[5].distrust == 0


# --- vectors


def plain_links(rows, threshold):
    ok = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((i, np.array(v, dtype=np.float64), label))
    links = {i: 0 for i, *_ in rows}
    edges = [(i, i) for i in links if i is not None]
    for k, (i, x, a) in enumerate(ok):
        for j, y, b in ok[:k]:
            if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    return links, brute(edges)


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 24)).astype(np.float32)
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(base)]
    rows += [(100 + k, [float(x) for x in base[k % 10] + rng.normal(size=24).astype(np.float32) * 0.2], (k % 10) % 3) for k in range(60)]
    rows += [(200 + k, rows[0][1], 0) for k in range(20)] + [(300, [2 * x for x in rows[1][1]], 1), (301, rows[1][1], 2), (302, rows[1][1], None)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 24, 0), (403, [None] + [1.0] * 23, 0), (404, [float("nan")] * 24, 0), (405, [float("inf")] + [1.0] * 23, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, component long")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    links, roots = plain_links(rows, 0.93)
    got = embed_dedup.dedup_embeddings(vectors, block=block).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.n_links for r in got} == links
    assert {r.vec_id: r.component_id for r in got} == roots and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.dedup_embeddings(vectors.limit(0)).count() == 0


def test_null_and_repeated_vector_ids(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = embed_dedup.dedup_embeddings(vectors).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 0), (1, 1), (1, 1)]


@pytest.mark.parametrize("cosine", [0.93, 0.95, 0.98])
def test_recall_at_the_threshold(cosine):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(axis=1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    a, b = embed_dedup.buckets(x), embed_dedup.buckets(cosine * x + np.sqrt(1 - cosine**2) * o)
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.99


def test_rotation_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(embed_dedup.hadamard(x) / 4, axis=1), np.linalg.norm(x, axis=1))


# --- token store


def token_rows():
    rng = random.Random(0)
    shared = " ".join(f"shared{rng.randrange(500)}" for _ in range(900))
    texts = [None, "", "short", "two  words\n"] + [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(400))) for _ in range(20)]
    texts += [f"before {k} " * k + shared + f" after {k}" for k in range(6)] + ["repeat " * 20_000]
    return [(k * 3 % 101, t, "x") for k, t in enumerate(texts)] + [(3, texts[1], "x"), (3, texts[1], "y"), (None, "null id", "x")]


def test_store_gives_every_document_back(spark, tmp_path, monkeypatch):
    rows, tokenizer = token_rows(), Tokenizer.from_file(BYTE)
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(5)
    path = f"file://{tmp_path}/store"
    store = token_store.TokenStore.write(docs, BYTE, end_id=2, path=path)
    want = sorted(((-1 if i is None else i), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows)
    for hot in (10_000, 0):
        monkeypatch.setattr(token_store, "HOT_DOCS", hot)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in store.read().collect())
        assert sorted((i, ids) for i, _, ids, _ in got) == want
        at = 0
        for _, start, ids, n in sorted(got, key=lambda g: g[1]):
            assert start == at and n == len(ids)
            at += n
        assert [g[0] for g in sorted(got, key=lambda g: g[1])] == [i for i, _ in want]
    assert store.verify_manifest() and zlib.crc32(b"") == 0
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    stored = sum(len(r.ids) for r in chunks.collect())
    assert stored < 2 * sum(len(ids) for _, ids in want)  # shared passages are stored once
    recipes = [r.doc_id for r in store.recipes.orderBy("start").collect()]
    assert recipes == sorted(recipes, key=lambda i: -1 if i is None else i)


def test_damaged_chunk_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here", "x")], "doc_id long, text string, x string")
    store = token_store.TokenStore.write(docs, BYTE, end_id=2, path=f"file://{tmp_path}/store")
    bad = spark.createDataFrame([(bytearray(r.hash), bytearray(bytes(r.ids[:-1]) + b"\x09")) for r in spark.table(store.table).collect()], "hash binary, ids binary")
    bad.write.saveAsTable("damaged_chunks", path=f"file://{tmp_path}/bad")
    store.table = "damaged_chunks"
    with pytest.raises(Exception, match="does not fit its hash"):
        store.read().collect()
    spark.sql("DROP TABLE damaged_chunks")


def test_losses_are_refused(spark, tmp_path):
    """A store without a chunk, a recipe or a part of its manifest raises instead of giving fewer documents."""
    docs = spark.createDataFrame([(k, f"text number {k} " * (k + 1), "x") for k in range(40)], "doc_id long, text string, x string")
    path = f"file://{tmp_path}/store"
    token_store.TokenStore.write(docs, BYTE, end_id=2, path=path).close()
    opened = token_store.TokenStore.open(spark, path)
    assert opened.read().count() == 40
    for name, message in (("chunks", "is missing"), ("recipes", "manifest"), ("manifest", "manifest")):
        damaged = f"{tmp_path}/without-{name}"
        shutil.copytree(f"{tmp_path}/store", damaged)
        rows = spark.read.parquet(f"{path}/{name}").toArrow()
        shutil.rmtree(f"{damaged}/{name}")
        os.mkdir(f"{damaged}/{name}")
        pq.write_table(rows.slice(1), f"{damaged}/{name}/part-00000-x_00000.c000.parquet")
        with pytest.raises(Exception, match=message):
            store = token_store.TokenStore.open(spark, f"file://{damaged}")
            if name == "chunks":
                store.table = f"parquet.`{damaged}/chunks`"
            store.read().collect()


def test_stream_of_leaves_gives_the_same_root():
    for n in range(40):
        leaves, tree = [token_store.digest(bytes([k])) for k in range(n)], token_store.MerkleStream()
        for leaf in leaves:
            tree.add(leaf)
        assert tree.root() == token_store.merkle(leaves)


def test_empty_store(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.TokenStore.write(docs, BYTE, end_id=2, path=f"file://{tmp_path}/store").read().count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    tail = rng.integers(0, 50_000, size=20_000).astype(np.uint32)

    def hashes(ids):
        ends = token_store.chunk_ends(token_store.cut_marks(ids), 0, len(ids))
        bounds = [0, *ends]
        assert bounds[-1] == len(ids)
        assert all(b - a <= token_store.MOST for a, b in zip(bounds, bounds[1:], strict=False))
        assert all(b - a >= token_store.LEAST for a, b in zip(bounds, bounds[1:-1], strict=False))
        return {token_store.digest(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)}

    one, two = hashes(tail), hashes(np.r_[rng.integers(0, 50_000, size=777).astype(np.uint32), tail])
    assert len(one & two) > 0.8 * len(one)
    assert token_store.merkle([b"a"]) == b"a" and token_store.merkle([b"a", b"b"]) != token_store.merkle([b"b", b"a"])


def test_words_with_marks_go_many_to_a_call(monkeypatch):
    """Rare words before marks are not encoded one by one; strings that hold the mark between pieces stay whole."""
    import pyarrow as pa

    from siltstone.llm import tokens

    enc = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    text = "Start" + "".join(f" qz{a}x{b}{end}" for a in "abcdé" for b in "efghß" for end in ("!!", "?", ";", ""))
    alone, library = [], enc._library
    monkeypatch.setattr(enc, "_library", lambda pieces: alone.extend(pieces) or library(pieces))
    want = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert enc.encode([text]) == [want] and alone == ["Start"]
    for values in ([], [""], ["a", "", "b"], ["a\x01b", "c"]):
        assert tokens.strings(pa.array(values, pa.string())) == values


def test_words_go_to_the_model_with_any_marks():
    """Rare words are encoded without the library's splitting, whatever ASCII marks follow; what it splits elsewhere is not."""
    from siltstone.llm import tokens

    enc = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    letters = [chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7)]
    words = [f" qz{a}x" for a in letters] + [f" {a}" for a in letters] + [f" vw{chr(m)}" for m in range(0x21, 0x7F)] + [f" vw{chr(m)}{chr(m)}&" for m in range(0x21, 0x7F)]
    words += [" don't", " 'll", " x'll", " a1", " 1a", " (x", " x-y", " a.b", " x\xd7", " \u4e2d\u6587", " \xc3\u0301", " ", ""]
    by_model, other = enc._by_model(words)
    assert {" qz\xe9x", " vw&", " vw&&&", " vw.", " vwA"} <= set(by_model) and {" don't", " a1", " 1a", " (x", " x-y", " a.b", " x\xd7", " vw'", " ", ""} <= set(other)
    for p, ids in by_model.items():
        assert ids == np.array(enc.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
    for text in ("A" + "".join(words[:-2]), "".join(reversed(words))):
        assert enc.encode([text]) == [np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]
    assert not tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json")).by_model


def test_texts_that_may_be_cut_everywhere():
    from siltstone.llm.tokens import _regular

    assert _regular(["one two\nthree, four. Five\xe9. six", "", "\xd6l, 7"])
    assert not any(_regular(["fine here", t]) for t in ("a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "a\rb", "a\xa0b", "a\u2003b", "a\x01b", "a .b", "(.", ",a", "\xd7.", "\xf7,", "\u4e2d."))
    assert _regular(["ends here ", " starts"])  # the two are texts of their own

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing, toxicity
from siltstone.llm._labelled import word_features
from siltstone.llm._runtime import Workspace

DATA = "/root/testdata/sf0.01"
BAD = ["vile", "awful", "rotten", "nasty"]


def corpus(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        words = [f"{lang}{rng.randrange(40)}" for _ in range(rng.randrange(20, 80))]
        bad = rng.random() < 0.25
        if bad:
            words += rng.choices(BAD, k=rng.randrange(2, 9))
            rng.shuffle(words)
        rows.append((k, " ".join(words), lang, bad))
        if k % 2 == 0:
            labels.append((k, int(bad) if rng.random() < 0.97 else 1))
    return rows, labels


def test_thresholds_stay_in_order_and_weights_are_shared():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, size=(600, 4)).astype(float)
    z = x @ np.array([2.0, 1.0, 0.0, 0.0]) + rng.logistic(size=600)
    grade = (z > 2).astype(int) + (z > 4)
    w, t = toxicity.fit_ordinal(x, grade, 3, steps=2000)
    assert t[0] < t[1] and abs(w[0] / w[1] - 2) < 0.5 and max(w[2:]) < 0.3 and abs(t[0] - 2) < 0.6 and abs(t[1] - 4) < 0.8


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, truth boolean, grade double")
    known = spark.createDataFrame([(*x, "extra") for x in labels], "doc_id long, toxic int, text string")
    got = toxicity.flag_toxic(docs, known).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id % 2]
    assert all(r.toxic == r.truth for r in held)
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.p_above_1 <= r.p_above_0 <= 1 and r.grade in (0, 1, 2) for r in got)


def test_many_rare_insults_held_out(spark):
    """A hundred insults, each in about 2 % of toxic rows; long toxic near copies share incidental words."""
    rng = random.Random(5)
    insults = [f"insult{k}" for k in range(100)]
    rows = []
    for k in range(8000):
        words = [f"w{min(int(rng.paretovariate(0.6)), 30_000)}" for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.2
        words += rng.sample(insults, 2) if bad else []
        rng.shuffle(words)
        rows.append((k, " ".join(words), bad))
    copied = [f"copied{k}" for k in range(300)] + ["insult0"]
    rows += [(8000 + k, " ".join([*copied, f"end{k}"]), True) for k in range(30)]
    rows += [(9000 + k, f"w1 w2 copied{k} w3", False) for k in range(20)]  # not labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth boolean")
    known = spark.createDataFrame([(i, int(bad)) for i, _, bad in rows if i % 2 == 0 and i < 9000], "doc_id long, toxic int")
    model = toxicity.train(known, docs, Workspace(spark, "test"))
    of_insults = {f for k in insults for f in word_features(k.encode())}
    assert sum(w for f, w in model.weights.items() if f not in of_insults) <= 0.1 * sum(model.weights.values())
    got = toxicity.score_toxicity(docs, model).where("doc_id % 2 = 1 OR doc_id >= 9000").collect()
    assert not [r for r in got if r.toxic and not r.truth]
    assert sum(r.toxic for r in got if r.truth) >= 0.98 * sum(r.truth for r in got)


def test_toxicity_edges(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(900, None), (901, ""), (902, "vile " * 60_000), (None, "aa1"), (0, rows[0][1])], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (901, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.flag_toxic(docs, known).collect()
    assert len(got) == len(rows) + 5
    flags = {r.doc_id: r.toxic for r in got}
    assert flags[902] and not flags[900] and not flags[901] and not flags[None]
    assert not any(r.toxic for r in toxicity.flag_toxic(docs, known.limit(0)).collect())
    assert not any(r.toxic for r in toxicity.flag_toxic(docs, known.where("toxic = 0")).collect())
    assert toxicity.flag_toxic(docs.limit(0), known).count() == 0


def test_toxicity_held_out_by_language(spark):
    """Labels of sf0.1: fitted on three quarters, judged on the rest, each language on its own."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    known = labels.where(~held).withColumnRenamed("label", "toxic")
    got = toxicity.flag_toxic(docs.join(labels, "doc_id"), known).where(held)
    counts = {(r[0], r[1], r[2]): r[3] for r in got.groupBy("lang", "label", "toxic").count().collect()}
    for lang in ("en", "de", "fr", "es"):
        hit, missed = counts.get((lang, 1, True), 0), counts.get((lang, 1, False), 0)
        wrong, clean = counts.get((lang, 0, True), 0), counts.get((lang, 0, False), 0)
        print(lang, "caught", hit, "of", hit + missed, "clean rejected", wrong, "of", wrong + clean)
        assert hit >= 0.8 * (hit + missed) and wrong <= 0.02 * (wrong + clean)


def test_scores_equal_brute_force(spark):
    model = toxicity.OrdinalModel({"=awful": 2.0, "<rot": 1.5, ">sty": 0.5, "<nas": 0.25}, (1.0, 3.0))
    texts = ["Awful, rotten nasty day", "", None, "rot sty", "nasty " * 5000, "a b"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, grade string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for k, text in enumerate(texts):
        words = [w for w in re.split(r"[^a-z]+", (text or "").lower()) if w]
        x = sum(2.0 * (w == "awful") + 1.5 * (w[:3] == "rot" != w) + 0.5 * (w[-3:] == "sty" != w) + 0.25 * (w[:3] == "nas" != w) for w in words)
        x *= 100 / (len(words) + toxicity.PRIOR_WORDS)
        want = [1 / (1 + math.exp(t - x)) if t - x < 500 else 0.0 for t in (1.0, 3.0)]
        assert np.allclose([got[k].p_above_0, got[k].p_above_1], want) and abs(got[k].expected_severity - sum(want)) < 1e-9


def test_domains_held_out_and_soft(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i,) for i, _ in labels], "doc_id long")
    work = Workspace(spark, "test")
    model = mixing.train_domains(known, docs, "lang", work)
    got = mixing.memberships(docs, model, "text").collect()
    held = [r for r in got if r.doc_id % 2]
    assert np.mean([model.domains[int(np.argmax(r.posterior))] == r.lang for r in held]) > 0.98
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    mixed = model.posterior(model.features([b"aa1", b"bb2"] * 20))
    assert mixed[0] > 0.1 and mixed[1] > 0.1


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mix_meets_targets(spark, floor):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r[:3], 9) for r in rows], "doc_id long, text string, lang string, rate int")
    known = spark.createDataFrame([(i,) for i, _ in labels], "doc_id long")
    goal = {"aa": 0.3, "bb": 0.4, "cc": 0.3}
    got = mixing.mix(docs, known, goal, floor=floor).collect()
    weight = np.array([r.rate * r.tokens for r in got])
    share = (weight[:, None] * np.array([r.posterior for r in got])).sum(axis=0) / weight.sum()
    assert np.allclose(share, [goal[k] for k in got[0].domains], atol=1e-3 if not floor else 2e-2)
    assert min(r.rate for r in got) >= floor and all(abs(r.copies - r.rate) < 1 + 1e-9 for r in got)
    if not floor:
        assert abs(weight.sum() - sum(r.tokens for r in got)) < 1e-3 * weight.sum()


def test_rates_equal_a_dense_solver(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], size=60)
    tokens = rng.integers(0, 100, size=60)
    frame = spark.createDataFrame([(k, int(t), [float(x) for x in q]) for k, (t, q) in enumerate(zip(tokens, p, strict=True))], "id long, tokens long, posterior array<double>")
    rate, residuals = mixing.fit_rates(frame, [0.7, 0.2, 0.1])
    got = np.array([r.rate for r in frame.withColumn("rate", rate).orderBy("id").collect()])
    a, goal = (p * tokens[:, None]).T, np.array([0.7, 0.2, 0.1]) * tokens.sum()
    assert np.allclose(a @ got, goal, rtol=1e-5) and residuals == sorted(residuals, reverse=True) and (got >= 0).all() and (got == 0).any()
    rate, floored = mixing.fit_rates(frame, [0.7, 0.2, 0.1], floor=1.0)
    got = np.array([r.rate for r in frame.withColumn("rate", rate).orderBy("id").collect()])
    total = max(tokens.sum(), *(a.sum(axis=1) / [0.7, 0.2, 0.1]))
    m = np.linalg.pinv((p * tokens[:, None]).T @ p)
    r = np.full(60, max(1.0, total / tokens.sum()))
    for _ in range(500):
        r = np.maximum(1, r - p @ (m @ (a @ r - np.array([0.7, 0.2, 0.1]) * total)))
    least = np.linalg.norm(a @ r - np.array([0.7, 0.2, 0.1]) * total) / np.linalg.norm(np.array([0.7, 0.2, 0.1]) * total)
    reached = np.linalg.norm(a @ got - np.array([0.7, 0.2, 0.1]) * total) / np.linalg.norm(np.array([0.7, 0.2, 0.1]) * total)
    assert (got >= 1).all() and floored == sorted(floored, reverse=True) and reached < least + 5e-3


def test_rates_fall_on_in_the_metric_with_momentum(spark):
    """Soft posteriors of six domains, far from any mix that matches: further than twice as many plain steps get."""
    rng = np.random.default_rng(0)
    p, tokens = rng.dirichlet(np.full(6, 2.0), 400), rng.integers(1, 2000, 400)
    share = rng.dirichlet(np.ones(6))
    frame = spark.createDataFrame([(k, int(t), q.tolist()) for k, (t, q) in enumerate(zip(tokens, p, strict=True))], "id long, tokens long, posterior array<double>").coalesce(2)
    rate, residuals = mixing.fit_rates(frame, share.tolist(), max_steps=20)
    got = np.array([r.rate for r in frame.withColumn("rate", rate).orderBy("id").collect()])
    a, goal = (p * tokens[:, None]).T, share * tokens.sum()
    m = np.linalg.pinv(a @ p)
    plain = np.ones(400)
    for _ in range(40):
        plain = np.maximum(0, plain - p @ (m @ (a @ plain - goal)))
    loss = lambda x: np.sqrt((a @ x - goal) @ m @ (a @ x - goal) / (goal @ m @ goal))
    assert (got >= 0).all() and abs(loss(got) - residuals[-1]) < 1e-5
    assert residuals == sorted(residuals, reverse=True) and loss(got) < loss(plain)


def test_mix_edges(spark):
    rows, labels = corpus(100)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(900, None, None), (901, "", "aa"), (None, "bb1 bb2", "bb"), (0, rows[0][1], rows[0][2]), (903, "aa1 " * 60_000, "aa")], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i,) for i, _ in labels] + [(None,), (900,)], "doc_id long")
    assert mixing.mix(docs, known, {"aa": 1.0, "bb": 1.0}).count() == docs.count()
    assert mixing.mix(docs.limit(0), known, {"aa": 1.0}).count() == 0
    assert mixing.mix(docs, known.limit(0), {"aa": 1.0}).count() == docs.count()

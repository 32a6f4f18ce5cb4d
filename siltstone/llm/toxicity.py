"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and their beginnings and endings of three to six letters;
a feature's value is its share of the text's words, so texts of any length
compare.  Those that stand out in toxic rows of the labelled sample by a
binomial test (which allows for the lengths of texts, counts near copies once
and bounds the share of false discoveries) enter the fit.  One weight per
feature is shared across the ordered thresholds::

    P(grade > k) = sigmoid(w . x - threshold[k]),  threshold[0] < threshold[1]

fitted with an L1 penalty on weights of zero or more: a rare feature must earn
a larger weight than a common one, so a beginning that many words share
outweighs those words, and no word makes up for an insult.  The score of a
document is its expected severity, the sum of those probabilities.

Labels know no degrees, so grades are a stated proxy: 0 where the label is 0;
where it is 1, grade 2 if features that passed the test make up at least the
median share of the toxic rows that hold any, else 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._labelled import labelled_sample, terms, word_features
from siltstone.llm._runtime import Workspace, few, used
from siltstone.llm.simhash import bands, shingle_set, sketch, sketch_bits

#: Labelled rows fitted on, at most: the bound of what reaches the driver.
SAMPLE_ROWS = 8000
#: Features fitted, at most; share of false ones among those that pass the test; least ratio of rates in toxic and other rows.
MAX_FEATURES, FALSE_SHARE, MIN_LIFT = 1000, 0.05, 3.0
#: Words added to each text's count before shares are taken, so that one word of a short text is no whole text.
PRIOR_WORDS = 100
#: Expected severity from which a document is rejected.
THRESHOLD = 0.5
L1 = 3e-4
#: Words a scorer remembers.
MEMO_WORDS = 300_000


class _Memo(dict):
    """Words to values, worked out when first asked for; emptied when full."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: bytes):
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = self.value(word)
        return found


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of a feature's share of the words (in percent), and ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def weight(self, word: bytes) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def scorer(self):
        """A function from a text to P(grade > k) for each threshold."""
        memo, edges = _Memo(self.weight), np.array(self.thresholds)

        def score(text: bytes | None) -> np.ndarray:
            words = terms(text)
            x = 100 * sum(map(memo.__getitem__, words)) / (len(words) + PRIOR_WORDS)
            return 1 / (1 + np.exp(np.clip(edges - x, -500, 500)))

        return score

    def score(self, text: bytes | None) -> np.ndarray:
        return self.scorer()(text)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l1: float = L1, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights (zero or more) and ordered thresholds by accelerated proximal gradient on the mean cumulative-link loss.

    Thresholds are a first one and logarithms of positive gaps, which keeps
    them in order.  ``l1`` is the penalty on a weight of a column of median size.
    """
    n, width = x.shape
    above = [(grade > k).mean() if n else 0.0 for k in range(grades - 1)]
    start = [-math.log((p + 1e-4) / (1 - p + 1e-4)) for p in above]
    thresholds = lambda t: np.cumsum([t[0], *np.exp(np.minimum(t[1:], 50))])
    size = np.sqrt((x * x).mean(axis=0)) + 1e-9 if n else np.ones(width)
    x = x / size  # columns of one size, so that rare terms move as fast as common ones
    penalty = l1 * np.median(size) / size if width else np.zeros(0)
    members = [grade == j for j in range(grades)]

    def loss(u: np.ndarray, slope: bool):
        w, t = u[:width], u[width:]
        edge, z = np.r_[-np.inf, thresholds(t), np.inf], x @ w
        f_low, f_high = (1 / (1 + np.exp(-np.clip(edge[grade + k] - z, -500, 500))) for k in (0, 1))
        p = np.maximum(f_high - f_low, 1e-12)
        value = -np.log(p).mean()
        if not slope:
            return value
        d_low, d_high = f_low * (1 - f_low) / p, f_high * (1 - f_high) / p
        per_edge = np.array([(d_low[members[j + 1]].sum() - d_high[members[j]].sum()) / n for j in range(grades - 1)])
        on_t = [per_edge.sum(), *(per_edge[j:].sum() * math.exp(min(t[j], 50)) for j in range(1, grades - 1))]
        return value, np.r_[x.T @ (d_high - d_low) / n, on_t]

    u = np.r_[np.zeros(width), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    if not n:
        return u[:width], thresholds(u[width:])
    step = 4.0 / max(1.0, np.linalg.norm(x, 2) ** 2 / n) if width else 1.0
    before, age, best = u, 0, loss(u, False)
    for _ in range(steps):
        v = u + age / (age + 3) * (u - before)
        value, slope = loss(v, True)
        while True:  # the step is halved until the loss lies below its quadratic bound
            following = v - step * slope
            following[:width] = np.maximum(following[:width] - step * penalty, 0)
            move = following - v
            if (reached := loss(following, False)) <= value + slope @ move + move @ move / (2 * step) + 1e-12:
                break
            step /= 2
        reached += penalty @ following[:width]
        if reached > best and age:  # momentum led astray: again without it
            age, before = 0, u
            continue
        before, u, age = u, following, age + 1
        if 0 <= best - reached < 1e-9 * age:
            break
        best = reached
    return u[:width] / size, thresholds(u[width:])


def _copies(sample: DataFrame) -> set[int]:
    """Rows of ``sample`` (row, toxic, text) that are near copies of a row before them with the same label."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            sets = [shingle_set(x.as_py()) for x in batch.column(2)]
            found = [pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (bands, lambda s: sketch(s).tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], ["row", "toxic", "bands", "sketch"])

    found = sample.select("row", "toxic", "text").mapInArrow(each, "row long, toxic int, bands array<long>, sketch array<long>").orderBy("row").toArrow().to_pylist()
    limit, first, copies = sketch_bits(0.8)[0], {}, set()
    prints = {r["row"]: np.array(r["sketch"], dtype=np.int64).view(np.uint64) for r in found}
    for r in found:
        for key in r["bands"]:
            other = first.setdefault((r["toxic"], key), r["row"])
            if other != r["row"] and np.bitwise_count(prints[other] ^ prints[r["row"]]).sum() <= limit:
                copies.add(r["row"])
    return copies


def _votes(sample: DataFrame, copies: set[int]) -> DataFrame:
    """(feature, n1, n0): toxic and other rows of ``sample`` that hold the feature, near copies left out; counted in each task first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, votes = _Memo(word_features), (Counter(), Counter())
        for batch in batches:
            for row, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if row not in copies:
                    votes[kind].update({f for w in set(terms(text.as_py())) for f in memo[w]})
        names = list(votes[0] | votes[1])
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([votes[k][f] for f in part], pa.int64()) for k in (1, 0))], ["feature", "n1", "n0"])

    rows = sample.select("row", "toxic", "text").mapInArrow(each, "feature string, n1 long, n0 long")
    return rows.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _within(short: str, long: str) -> bool:
    """Whether every word with the feature ``long`` has the feature ``short``."""
    if short[0] == "=" or long[0] not in ("=", short[0]):
        return False
    return long[1:].startswith(short[1:]) if short[0] == "<" else long[1:].endswith(short[1:])


def _markers(table: DataFrame) -> list[str]:
    """Features of (feature, n1, n0) that stand out in toxic rows, the surest first, MAX_FEATURES at most.

    A feature that tells nothing is in a toxic row with the share q that toxic
    rows have of all (row, feature) pairs, whatever the lengths of texts.  The
    probability of n1 or more of n such rows is exp(-n KL(n1 / n, q)) at most
    (Chernoff).  Of the ordered bounds those are taken that keep the expected
    share of false discoveries at FALSE_SHARE (Benjamini and Hochberg).  Of
    features in the same rows, one within the other, the longest stays.
    """
    toxic, pairs, tests = table.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum(F.col("n1") + F.col("n0")), F.lit(0)), F.count("*")).first()
    if not 0 < toxic < pairs:
        return []
    q = toxic / pairs
    n, p = F.col("n1") + F.col("n0"), F.col("n1") / (F.col("n1") + F.col("n0"))
    rest = F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - p) / F.lit(1 - q))).otherwise(0.0)
    lift = (F.col("n1") / F.lit(toxic)) / ((F.col("n0") + 1) / F.lit(pairs - toxic + 1))
    found = table.where(F.col("n1") > n * F.lit(q)).select("feature", "n1", "n0", (F.col("n1") * F.log(p / F.lit(q)) + rest).alias("gain"), lift.alias("lift"))
    # no bound passes without exp(-gain) <= FALSE_SHARE, whatever its place; ties keep the order defined
    least = math.log(tests / FALSE_SHARE) - math.log(8 * MAX_FEATURES)
    ordered = found.where((F.col("gain") >= least) & (F.col("lift") >= MIN_LIFT)).orderBy(F.desc("gain"), "feature").limit(8 * MAX_FEATURES).collect()
    last = max((k for k, r in enumerate(ordered, 1) if r["gain"] >= math.log(tests / (FALSE_SHARE * k))), default=0)
    chosen, same = [], {}
    for r in sorted(ordered[:last], key=lambda r: (-r["gain"], -len(r["feature"]), r["feature"])):
        alike = same.setdefault((r["n1"], r["n0"]), [])
        if not any(_within(r["feature"], other) for other in alike):
            alike.append(r["feature"])
            chosen.append(r["feature"])
    return chosen[:MAX_FEATURES]


def train(labels: DataFrame, docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fits the model on the labelled rows that hash lowest, ``sample_rows`` at most.

    Without a toxic row in the sample no feature has a weight and every document
    gets the share of toxic rows as its severity.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("toxic"))
    drawn = labelled_sample(known, docs, sample_rows, id_col, text_col, ["toxic"])
    sample = work.stage(drawn.dropDuplicates(["text"]).withColumn("row", F.monotonically_increasing_id()), "sample")  # copies are no further evidence
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 + n1:
        return OrdinalModel({}, (50.0, 51.0))
    chosen: list[str] = []
    if n0 and n1:
        chosen = _markers(work.stage(_votes(sample, _copies(sample)), "votes"))
    index = {t: k for k, t in enumerate(chosen)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(lambda word: [index[f] for f in word_features(word) if f in index])
        for batch in batches:
            ids, shares, marked = [], [], []
            for text in batch.column(0):
                words = terms(text.as_py())
                hits = [memo[w] for w in words]
                counts = Counter(k for h in hits for k in h)
                ids.append(list(counts))
                shares.append([100 * c / (len(words) + PRIOR_WORDS) for c in counts.values()])
                marked.append(100 * sum(map(bool, hits)) / (len(words) + PRIOR_WORDS))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64())), pa.array(marked, pa.float64())], ["toxic", "ids", "shares", "marked"])

    rows = sample.select("text", "toxic").mapInArrow(features, "toxic int, ids array<int>, shares array<double>, marked double").collect()
    x, toxic = np.zeros((len(rows), len(chosen))), np.array([r["toxic"] for r in rows])
    held = np.array([r["marked"] for r in rows])
    for k, r in enumerate(rows):
        x[k, r["ids"]] = r["shares"]
    grade = toxic.astype(np.int64)
    marked = held[(toxic == 1) & (held > 0)]
    if len(marked):
        grade[(toxic == 1) & (held >= np.median(marked))] = 2
    w, thresholds = fit_ordinal(x, grade, 3)
    return OrdinalModel({t: float(w[k]) for t, k in index.items() if w[k]}, tuple(float(t) for t in thresholds))


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_above_0, p_above_1, expected_severity, grade and toxic added.

    ``grade`` is the most probable grade, ``toxic`` whether expected_severity
    reaches ``threshold``.  Null and empty texts score as texts without words.
    Rows, order of columns and other columns are kept; columns of ``docs`` of
    those names are replaced.
    """
    schema_names = ["p_above_0", "p_above_1", "expected_severity", "grade", "toxic"]

    @F.pandas_udf("p_above_0 double, p_above_1 double")
    def above(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for texts in batches:
            yield pd.DataFrame([score(t) for t in texts], columns=["p_above_0", "p_above_1"])
            used(sum(len(t) for t in texts if t is not None))

    kept = [c for c in docs.columns if c not in schema_names]
    rows = docs.select(F.struct(*kept).alias("row"), above(F.col(text_col).cast("binary")).alias("p"))
    p0, p1 = F.col("p.p_above_0"), F.col("p.p_above_1")
    grade = F.when((1 - p0 >= p0 - p1) & (1 - p0 >= p1), 0).when(p0 - p1 >= p1, 1).otherwise(2)
    return rows.select("row.*", p0.alias("p_above_0"), p1.alias("p_above_1"), (p0 + p1).alias("expected_severity"), grade.alias("grade"), (p0 + p1 >= threshold).alias("toxic"))


def flag_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """:func:`score_toxicity` by a model trained on ``labels`` (id_col, toxic 0/1; others ignored) and their texts in ``docs``."""
    model = train(labels, docs, Workspace(docs.sparkSession, "toxicity"), id_col, text_col, sample_rows=sample_rows)
    return score_toxicity(docs, model, text_col, threshold)

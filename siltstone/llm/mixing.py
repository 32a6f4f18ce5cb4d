"""Mixing to target weights with soft domain membership.

A classifier trained on labelled rows gives each document a posterior over
domains.  Document rates r >= floor are fitted so that the expected domain
token totals A r, A[d, i] = tokens[i] * posterior[i, d], match targets b:
projected gradient on the least squares |M^-1/2 (A r - b)|^2 with
M = sum_i tokens[i] p_i p_i', in which a document's step is p_i . M^-1 (A r - b).
The sum in M goes over documents above the floor as long as that lowers the
residual fast, then over all, with momentum that starts anew where it
overshoots.  Each step is one aggregation to a few numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._labelled import labelled_sample, term_table, terms
from siltstone.llm._runtime import Workspace, used

#: Labelled rows fitted on, at most, and terms that are features: the bounds of what reaches the driver.
SAMPLE_ROWS, MAX_TERMS = 3000, 400
#: Steps at most, and relative residual, or fall of it in a step, at which they end.
MAX_STEPS, TOLERANCE = 60, 1e-7
#: Momentum of a step, and what it takes off a rate a unit of posterior.
Step = tuple[float, np.ndarray]


@dataclass(frozen=True)
class DomainModel:
    """Multinomial logistic regression on square roots of term shares."""

    domains: tuple[str, ...]
    index: dict[bytes, int]
    weights: np.ndarray  # terms + 1, domains; the last row is the bias

    def features(self, words: list[bytes]) -> np.ndarray:
        x = np.zeros(len(self.index) + 1)
        for t, n in Counter(w for w in words if w in self.index).items():
            x[self.index[t]] = n
        x /= max(1, len(words))
        np.sqrt(x, out=x)
        x[-1] = 1.0
        return x

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights (columns of x, classes) by accelerated gradient on the mean cross-entropy."""
    n = len(x)
    w = before = np.zeros((x.shape[1], classes))
    hot = np.eye(classes)[y]
    step = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 / n + ridge)
    for k in range(steps):
        v = w + k / (k + 3) * (w - before)
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        before, w = w, v - step * (x.T @ (p - hot) / n + ridge * v)
    return w


def train_domains(labels: DataFrame, docs: DataFrame, domain_col: str, work: Workspace, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DomainModel:
    """A model of ``domain_col`` (a column of either table) on the labelled rows that hash lowest.

    Features are the terms in most rows of the sample.  Rows without a domain
    are not used; with no row left there is one domain, ''.
    """
    keep = work.stage(labelled_sample(labels, docs, sample_rows, id_col, text_col, [domain_col]).where(F.col(domain_col).isNotNull()), "sample")
    keep = keep.select("text", F.col(domain_col).cast("string").alias("domain"))
    domains = tuple(sorted(r["domain"] for r in keep.select("domain").distinct().collect())) or ("",)
    common = term_table(keep, "domain").groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(MAX_TERMS)
    model = DomainModel(domains, {r["term"].encode(): k for k, r in enumerate(common.collect())}, np.zeros((0, 0)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(terms(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), batch.column(1)], ["x", "domain"])

    rows = keep.mapInArrow(features, "x array<float>, domain string").toArrow()
    if not rows.num_rows:
        return DomainModel(domains, {}, np.zeros((1, 1)))
    x = rows["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, -1)
    y = np.array([domains.index(d) for d in rows["domain"].to_pylist()])
    return DomainModel(domains, model.index, fit_softmax(x, y, len(domains)))


def memberships(docs: DataFrame, model: DomainModel, text_col: str) -> DataFrame:
    """``docs`` with ``tokens`` (words) and ``posterior`` (array in the model's order of domains)."""

    @F.pandas_udf("tokens long, posterior array<double>")
    def member(texts):
        import pandas as pd

        tokens, posterior = [], []
        for text in texts:  # one text's words at a time
            words = terms(text)
            tokens.append(len(words))
            posterior.append(model.posterior(model.features(words)))
        used(sum(len(t) for t in texts if t is not None))
        return pd.DataFrame({"tokens": tokens, "posterior": posterior})

    return docs.select(F.struct(*docs.columns).alias("row"), member(F.col(text_col).cast("binary")).alias("m")).select("row.*", "m.tokens", "m.posterior")


def replay(posterior: np.ndarray, first: float, floor: float, steps: list[Step]) -> np.ndarray:
    """Rates of documents (rows of ``posterior``) after the steps (momentum, move), from ``first`` on."""
    rate = before = np.full(len(posterior), first)
    for momentum, move in steps:
        ahead = rate + momentum * (rate - before)
        before, rate = rate, np.maximum(floor, ahead - posterior @ move)
    return rate


def _sums(rows: DataFrame, d: int, first: float, floor: float, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """A r, and M over the documents whose rate is above the floor: d and d * d numbers a partition, added up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + d * d)
        for batch in batches:
            if batch.num_rows:
                tokens = batch.column(0).to_numpy().astype(np.float64)
                p = batch.column(1).flatten().to_numpy().reshape(-1, d)
                rate = replay(p, first, floor, steps)
                total[:d] += (tokens * rate) @ p
                total[d:] += ((p * (tokens * (rate > floor))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    part = rows.select("tokens", "posterior").mapInArrow(each, "s array<double>")
    row = np.array(part.agg(*[F.coalesce(F.sum(F.col("s")[k]), F.lit(0.0)) for k in range(d + d * d)]).first())
    return row[:d], row[d:].reshape(d, d)


def fit_rates(rows: DataFrame, targets: list[float], total: float | None = None, floor: float = 0.0, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[Column, list[float]]:
    """Rates as a column over ``posterior``, and the falling relative residuals (in the metric M^-1) on the way.

    ``targets``: the share of each domain.  ``total``: tokens of the mix; None
    stands for those of the rows, or, with a positive floor, for the least
    mix that matches the targets with every rate at the floor or above.

    The state is the list of steps, d numbers each, that a worker replays on
    its rows; so no plan grows, and a step is one pass over narrow rows.  It
    ends where the residual is below ``tolerance``, or where two steps on end
    lower it by less than that share of itself.
    """
    d = len(targets)
    tokens = F.col("tokens").cast("double")
    p = [F.element_at("posterior", k + 1) for k in range(d)]
    sums = rows.agg(*[F.coalesce(F.sum(tokens * a), F.lit(0.0)) for a in p], *[F.coalesce(F.sum(tokens * a * b), F.lit(0.0)) for a in p for b in p]).first()
    per, have = np.array(sums[:d]), float(sum(sums[:d]))
    ridge = np.eye(d) * 1e-9 * max(have, 1.0)
    metric = np.linalg.pinv(np.array(sums[d:]).reshape(d, d) + ridge)
    share = np.array(targets, dtype=float) / sum(targets)
    if total is None:
        total = have if floor <= 0 else floor * max([have, *(per[k] / share[k] for k in range(d) if share[k] > 0)])
    goal = share * total
    first = float(max(floor, total / have if have else 1.0))
    scale = max(float(goal @ metric @ goal), 1e-300)

    def loss(mix: np.ndarray) -> float:
        return float((mix - goal) @ metric @ (mix - goal)) / scale

    steps: list[Step] = []
    mix = before = per * first
    residuals, t, newton, slow = [loss(mix) ** 0.5], 1.0, True, 0
    free = np.linalg.pinv(np.array(sums[d:]).reshape(d, d) * (first > floor) + ridge)
    for _ in range(max_steps if have else 0):
        if residuals[-1] < tolerance or slow == 2:
            break
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum = 0.0 if newton else (t - 1) / grown
        off = mix + momentum * (mix - before) - goal
        trial = [*steps, (momentum, (free if newton else metric) @ off)]
        found, above = _sums(rows, d, first, floor, trial)
        fallen = loss(found) ** 0.5
        if newton and fallen > 0.7 * residuals[-1]:
            newton = False  # from here on in the metric of all rows, with momentum
        elif fallen > residuals[-1]:
            if momentum == 0.0:
                break
            t = 1.0  # the momentum overshot: a plain step instead
        else:
            slow = slow + 1 if not newton and residuals[-1] - fallen < tolerance * residuals[-1] else 0
            steps, before, mix, t = trial, mix, found, t if newton else grown
            free = np.linalg.pinv(above + ridge)
            residuals.append(fallen)

    @F.pandas_udf("double")
    def rate(posterior):
        import pandas as pd

        return pd.Series(replay(np.stack(posterior.to_list()) if len(posterior) else np.zeros((0, d)), first, floor, steps))

    return rate(F.col("posterior")), residuals


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", total: float | None = None, floor: float = 0.0, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``docs`` with tokens, posterior, domains, rate and copies added.

    ``targets``: weight of each domain; a domain not named has target 0.
    ``copies`` rounds the rate up or down by chance (a hash of id and text),
    so that its mean is the rate.  A text without words weighs nothing and
    keeps a rate by its prior.  Rows and other columns are kept; columns of
    those names are replaced; an empty table gives none.
    """
    added = ["tokens", "posterior", "domains", "rate", "copies"]
    work = Workspace(docs.sparkSession, "mixing")
    model = train_domains(labels, docs, domain_col, work, id_col, text_col, sample_rows)
    goal = [max(0.0, targets.get(k, 0.0)) for k in model.domains]
    if not sum(goal):
        goal = [1.0] * len(goal)
    rows = work.stage(memberships(docs.drop(*added), model, text_col), "members")
    rate, _ = fit_rates(rows.select("tokens", "posterior"), goal, total, floor)
    names = F.array(*[F.lit(k) for k in model.domains])
    rows = rows.withColumn("domains", names).withColumn("rate", rate)
    chance = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))

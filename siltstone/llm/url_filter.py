"""URL filters: longest-match rules, and trust spread over the host link graph where no rule fits.

Hosts whose pages are mostly allowed by rules are trusted seeds, hosts whose
pages are mostly blocked are distrusted seeds.  Trust flows along links,
distrust flows against them (a host that links to blocked hosts earns
distrust), both as personalised PageRank.  Every seed host starts with a mass
of one, so a host near one blocked seed and one trusted seed is judged by how
near they are, not by how many other seeds there are.  A host is blocked when
its distrust exceeds its trust :data:`BLOCK_RATIO` times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._runtime import Workspace

DAMPING = 0.85
#: Change of all scores of a kind, over their sum, at which propagation ends.
TOLERANCE = 1e-6
BLOCK_RATIO = 1.0
#: Links of a host that one unit of a join holds at most, in the mean; a host with more is dealt over several.
HUB_LINKS = 100_000
#: Steps between two written tables.
STEPS_A_TABLE = 5
#: Share of a host's pages that rules must allow (block) to make it a trusted (distrusted) seed.
SEED_SHARE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\shref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``action`` ('allow' or 'block') for urls of ``host`` and its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def pattern(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(pattern, action) of the longest rule that fits, or nulls; rules are a short parameter, tried longest first."""
    pattern, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), len(r.host), r.pattern)):
        fits = rule.fits(host, path)
        pattern, action = F.when(fits, rule.pattern).otherwise(pattern), F.when(fits, rule.action).otherwise(action)
    return pattern, action


def host_links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): absolute and protocol-relative links between different hosts; relative links stay on their host."""
    link = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(_LINK), 1)))
    rows = pages.where(F.col(html).contains("//") & (F.col(host) != "")).select(F.col(host).alias("src"), link.alias("url"))
    target = F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), F.col("url"))).otherwise(F.col("url"))
    return rows.select("src", host_of(target).alias("dst")).where("dst != '' AND dst != src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, work: Workspace, damping: float = DAMPING, tolerance: float = TOLERANCE, hub_links: int = HUB_LINKS) -> DataFrame:
    """Personalised PageRank: links (kind, src, dst, n), seeds (kind, host, seed) to (kind, host, score).

    What hosts without links would pass on returns to the seeds: that scales
    all scores of a kind alike, so it is done once, at the end, where scores
    are given the sum of their kind's seeds.  Each step joins the scores with
    links and adds up per (kind, dst), partly before the shuffle; a host with
    very many links is dealt over several units.  Steps go on until scores move
    by less than ``tolerance`` of their sum; they shrink by ``damping`` each.
    """
    out = work.stage(links.groupBy("kind", "src").agg(F.sum("n").alias("of"), F.ceil(F.count("*") / F.lit(float(hub_links))).cast("int").alias("units")), "out")
    hubs = F.broadcast(out.where("units > 1").select("kind", "src", "units"))  # one row per hub_links links at most
    unit = F.pmod(F.xxhash64("dst"), F.coalesce("units", F.lit(1)).cast("long")).cast("int").alias("unit")
    dealt = work.stage(links.join(hubs, ["kind", "src"], "left").select("kind", "src", unit, "dst", "n"), "dealt")
    restart = work.stage(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score")), "restart")
    if dealt.isEmpty() or restart.isEmpty():
        return seeds.select("kind", "host", F.col("seed").cast("double").alias("score"))
    scores, step = restart, 0
    every = F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit")
    while True:
        before = scores
        for _ in range(STEPS_A_TABLE):
            given = scores.withColumnRenamed("host", "src").join(out, ["kind", "src"]).select("kind", "src", (F.col("score") / F.col("of")).alias("share"), every)
            passed = dealt.join(given, ["kind", "src", "unit"]).select("kind", F.col("dst").alias("host"), (F.col("n") * F.col("share") * damping).alias("score"))
            scores = restart.unionByName(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            step += 1
        scores = work.stage(scores, f"scores{step}")
        both = scores.withColumnRenamed("score", "now").join(before, ["kind", "host"], "left").groupBy("kind")
        moved = both.agg((F.sum(F.abs(F.col("now") - F.coalesce("score", F.lit(0.0)))) / F.sum("now")).alias("part")).agg(F.max("part")).first()[0]
        if step > STEPS_A_TABLE:
            work.drop(f"scores{step - STEPS_A_TABLE}")
        if (moved or 0.0) < tolerance:
            break
    scale = scores.groupBy("kind").agg(F.sum("score").alias("got")).join(seeds.groupBy("kind").agg(F.sum("seed").alias("given")), "kind")
    return scores.join(F.broadcast(scale), "kind").select("kind", "host", (F.col("score") * F.col("given") / F.col("got")).alias("score"))  # a row a kind


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seed_share: float = SEED_SHARE) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, trust, distrust.

    The verdict is the longest rule's, else 'block' where the host's distrust
    exceeds BLOCK_RATIO times its trust, else 'allow'.  A null url, or one without ``://``, has
    empty host and path and no rule, and is allowed; null html has no links.
    Repeated rows give one row each and count as pages each; other columns are
    not read.
    """
    work = Workspace(pages.sparkSession, "urls")
    url, host, path = F.col(url_col), F.col("host"), F.col("path")
    named = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    pattern, action = longest_rule(rules, host, path)
    ruled = work.stage(named.select("id", "host", "path", pattern.alias("rule"), action.alias("action")), "ruled")
    links = work.stage(host_links(named), "links")
    hosts = ruled.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("allow"), F.count_if(F.col("action") == "block").alias("block")
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("hits")) for k, c in (("trust", "allow"), ("distrust", "block"))]))
    raw = work.stage(hosts.select("host", "n", kinds.alias("k")).where(F.col("k.hits") > F.col("n") * seed_share).select("k.kind", "host"), "seeds")
    seeds = raw.select("kind", "host", F.lit(1.0).alias("seed"))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    scores = propagate(both, seeds, work)
    per_host = scores.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust")
    )
    judged = ruled.join(per_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce("action", F.when(F.col("distrust") > BLOCK_RATIO * F.col("trust"), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")

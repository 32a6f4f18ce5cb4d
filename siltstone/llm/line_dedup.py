"""Line dedup by site-relative frequency.

A line is boilerplate of its site when the share of the site's pages that hold
it exceeds a ratio.  Lines are compared without the spaces at their ends; blank
lines are never boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._runtime import Workspace

#: Share of a site's pages, and number of pages, above which (from which) a line is boilerplate.
RATIO = 0.02
MIN_PAGES = 5
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if counted to be small, else as it is for a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hashes(c: Column) -> Column:
    """128 bits in two halves."""
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"))


def dedup_lines(
    docs: DataFrame, site: str = "source", id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_first: bool = False
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and ``n_lines``, ``n_dropped`` added.

    Every row is a page.  ``ratio`` and ``min_pages`` as in
    :data:`RATIO`, :data:`MIN_PAGES`.  With ``keep_first`` a line stays in the
    page of its site with the least (id, text hash), so no text vanishes.
    Rows and other columns are kept; a null text stays null with 0 lines, an
    empty one has one line; rows without a site are a site of their own.
    Columns of ``docs`` named n_lines or n_dropped are replaced.

    Lines are shuffled as hashes, partly aggregated.  A site has at most
    (mean lines of its pages) / ratio boilerplate lines, so they are one row
    per site; if all of them together are counted to be few, they are
    broadcast and texts are not shuffled, else texts are joined by site.
    """
    work = Workspace(docs.sparkSession, "lines")
    text, key = F.col(text_col), F.coalesce(F.col(site).cast("string"), F.lit(""))
    page = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), _hashes(text).alias("t"))
    split = F.split(text, "\n")
    found = F.array_distinct(F.transform(F.filter(split, lambda x: F.trim(x) != ""), lambda x: _hashes(F.trim(x))))
    lines = docs.select(key.alias("site"), page.alias("page"), F.explode(found).alias("line"))
    totals = _small(docs.groupBy(key.alias("site")).agg(F.count("*").alias("pages")))
    counted = lines.groupBy("site", "line").agg(F.count("*").alias("n"), F.min("page").alias("first")).where(F.col("n") >= min_pages)
    often = work.stage(counted.join(totals, "site").where(F.col("n") > F.col("pages") * ratio).select("site", "line", "first"), "often")
    entry = F.struct("line", "first")
    per_site = often.groupBy("site").agg(F.collect_list(entry).alias("_found"))
    per_site = per_site.select(F.col("site").alias("_site"), "_found", F.transform("_found", lambda e: e["line"]["h1"]).alias("_h1"))
    if often.count() <= BROADCAST_ROWS:
        per_site = F.broadcast(per_site)
    rows = docs.drop("n_lines", "n_dropped").withColumn("_site", key)
    joined = rows.join(per_site, "_site", "left").withColumn("_page", page)

    def dropped(line: Column) -> Column:
        full = _hashes(F.trim(line))
        same = F.exists("_found", lambda e: (e["line"] == full) & (e["first"] != F.col("_page")) if keep_first else e["line"] == full)
        return F.array_contains("_h1", F.xxhash64(F.trim(line))) & same

    kept = F.when(F.col("_found").isNull(), split).otherwise(F.filter(split, lambda x: ~dropped(x)))
    n = F.coalesce(F.size(split), F.lit(0))
    joined = joined.withColumn("_kept", kept).withColumn("n_lines", F.when(text.isNull(), 0).otherwise(n).cast("long"))
    joined = joined.withColumn("n_dropped", F.when(text.isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
    return joined.withColumn(text_col, F.when(F.size("_kept") == F.size(split), text).otherwise(F.array_join("_kept", "\n"))).select(
        *[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"
    )

"""Site-relative line frequency: lines that a large share of a site's pages contain are boilerplate.

Only DataFrame functions.  Counting shuffles one hash and one partial count for each line of a page; the
lines found are few by construction (a site has at most its mean lines a page over the ratio), go back to the pages
as one array for each site, and only a counted-small table is broadcast; otherwise sites are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved

SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = 0.1, least: int = 2) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``, and columns lines_in and lines_dropped (longs) added.

    ``host`` is a column or expression that names a page's site; null is a site of its own.  Lines end at 0x0A and are
    compared without leading and trailing spaces; blank lines are always kept.  A line is dropped from every page of a
    site when more than ``ratio`` of that site's rows contain it; a line that fewer than ``least`` rows have (by default, that one
    page alone has) repeats nothing and stays.  A null text stays
    null with 0 lines and counts as a page; repeated rows are separate pages; texts are taken whole, however long.  Other columns are kept
    as they are, but lines_in and lines_dropped are replaced where they exist.  An empty table gives an empty result.
    """
    host = F.col(host) if isinstance(host, str) else host
    pages = docs.select(host.alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    common = counts.join(F.broadcast(totals), counts.host.eqNullSafe(totals.host)) if _few(totals) else counts.join(totals, counts.host.eqNullSafe(totals.host))
    common = saved(common.filter(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy(counts.host.alias("boiler_host")).agg(F.collect_set("line").alias("boiler_lines")))

    size = common.agg(F.coalesce(F.sum(F.size("boiler_lines") + 8), F.lit(0))).head()[0]
    names = set(docs.columns)
    mark, key, arr, site, left_over = (next(n for n in (f"{base}{k}" for k in ["", *range(len(names) + 1)]) if n not in names) for base in ("_salt", "_host", "_boiler", "_site", "_kept"))
    common = common.select(F.col("boiler_host").alias(key), F.col("boiler_lines").alias(arr))
    if size <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(common), host.eqNullSafe(F.col(key)), "left")
    else:
        spread = common.withColumn(mark, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn(mark, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).withColumn(site, host)
        joined = left.join(spread, left[mark].eqNullSafe(spread[mark]) & left[site].eqNullSafe(spread[key]), "left").drop(left[mark]).drop(spread[mark]).drop(site)
    kept = F.when(F.col(arr).isNull(), _lines(F.col(text))).otherwise(F.filter(_lines(F.col(text)), lambda x: (F.trim(x) == "") | ~F.array_contains(arr, _key(x))))
    lines = F.coalesce(F.size(_lines(F.col(text))), F.lit(0))
    lines = F.when(F.col(text).isNull(), 0).otherwise(lines).cast("long")
    out = joined.withColumn("lines_in", lines).withColumn(left_over, kept)
    out = out.withColumn("lines_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.col("lines_in") - F.size(left_over)).cast("long")).withColumn(text, F.array_join(left_over, "\n"))
    return out.select(*(c for c in docs.columns if c not in ("lines_in", "lines_dropped")), "lines_in", "lines_dropped")


def _few(totals: DataFrame) -> bool:
    return totals.count() <= BROADCAST_ROWS

"""Mixing sources to target weights: whole documents are taken by thresholds on a hash of them, found from histograms.

Each source's target is its weighted share of the budget, at most ``repeats`` times its size.  A source is taken as often as it fits whole; for
the rest, documents whose hash lies below a threshold are taken once more.  Sizes are summed by source and hash bucket; the one bucket in which the
rest ends is split into finer buckets, from its own rows alone, until one hash is left.  Nothing is sorted, and a larger budget takes all that a
smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, numbered, saved, settled_join

#: Hashes have so many bits, and each level of histograms looks at so many more of them.
BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column, text: Column) -> Column:
    """A hash of ``BITS`` bits from the id and the text, so that rows without ids are told apart by their texts."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, text)`` as (doc_id, source, size, place): words of the text (null: 0) and its hash.  Other columns are not looked at."""
    text = F.col("text")
    return docs.select("doc_id", "source", _size(text).alias("size"), _place(F.col("doc_id"), text).alias("place"))


def cyclic_weights(rows: DataFrame, cycle: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(source, weight) of the distinct sources in order of code points, null last, the weights of ``cycle`` in turn."""
    ranked = numbered(rows.select("source").distinct(), F.asc_nulls_last("source"))
    return ranked.select("source", F.element_at(F.array(*map(F.lit, cycle)), (F.col("index") % len(cycle) + 1).cast("int")).cast("long").alias("weight"))


def targets(totals: DataFrame, shares: Sequence[float], repeats: int) -> DataFrame:
    """``totals(…, source_size, weight)`` with ``targets``, one for each share of all sizes, largest at ``repeats`` times the source's size.

    Rounds take the sources above their limit out at that limit and share the rest by weight among the others, until none is above.
    """
    size, weight, limit = F.col("source_size"), F.col("weight"), F.col("source_size") * repeats
    everything = totals.agg(F.sum("source_size"), F.sum("weight")).first()
    budgets = [share * (everything[0] or 0) for share in shares]
    state = [(0, everything[1] or 0) for _ in shares]  # what the limited ones take, and the weight of the others

    def fair(k):
        capped, free = state[k]
        return weight * F.lit(float(budgets[k] - capped)) / F.lit(float(free)) if free else limit.cast("double")

    while True:
        above = [fair(k) > limit for k in range(len(shares))]
        found = totals.agg(*(F.sum(F.when(a, limit).otherwise(0)) for a in above), *(F.sum(F.when(a, 0).otherwise(weight)) for a in above)).first()
        new = [(found[k] or 0, found[k + len(shares)] or 0) for k in range(len(shares))]
        if new == state:
            return totals.withColumn("targets", F.array(*(F.least(fair(k), limit.cast("double")) for k in range(len(shares)))))
        state = new


def thresholds(rows: DataFrame, weights: DataFrame, shares: Sequence[float] = (1.0,), repeats: int = 3) -> DataFrame:
    """What to take of each source: (key, source, source_size, weight, targets, passes, until), the last three with an entry for each share.

    ``rows`` is ``measured(docs)``, saved; ``weights(source, weight)`` has a row for each source (one without a row, or with a weight of 0 or null,
    gets nothing).  A document is taken ``passes`` times, and once more if its place is below ``until``.  The place at which a source's target is
    reached is taken if that comes nearer to the target (or as near) than to leave it out; rows with equal id and text share a place and go together.
    """
    keyed = rows.select(_source_key(F.col("source")).alias("key"), "source", "size", "place")
    sums = keyed.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weight = weights.groupBy(_source_key(F.col("source")).alias("key")).agg(F.max("weight").cast("long").alias("weight"))
    totals = saved(sums.join(weight, "key", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long")))
    # Double precision may bring floor(target / size) to one too many or leave a rest of less than nothing; then the rest is nothing.
    passes = F.transform("targets", lambda t: F.when(F.col("source_size") > 0, F.floor(t / F.col("source_size"))).otherwise(0))
    aims = saved(targets(totals, shares, repeats).withColumn("passes", passes))
    rest = F.arrays_zip("targets", "passes")
    todo = aims.select("key", "source_size", F.posexplode(rest).alias("k", "z")).select("key", "k", (F.col("z.targets") - F.col("z.passes") * F.col("source_size")).alias("rest"))
    todo = saved(todo.filter("rest > 0").select("key", "k", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("parent")))
    level_rows, shift, found, scratch = keyed.filter("size > 0").select("key", "size", "place"), BITS, [], [totals, todo]
    while True:
        shift -= STEP
        prefix = F.shiftright("place", shift)
        sums = level_rows.groupBy("key", prefix.alias("prefix")).agg(F.sum("size").alias("s"), F.min("place").alias("low"), F.max("place").alias("high"))
        sums = sums.withColumn("parent", F.shiftright("prefix", STEP))
        upto = F.sum("s").over(Window.partitionBy("key", "parent").orderBy("prefix"))  # at most 2 ** STEP rows
        ends = todo.join(sums.withColumn("upto", upto), ["key", "parent"])
        ends = ends.withColumn("upto", F.col("before") + F.col("upto")).filter("upto - s < rest and rest <= upto")
        ends = saved(ends.select("key", "k", "rest", (F.col("upto") - F.col("s")).alias("before"), F.col("prefix").alias("parent"), "s", "low", "high"))
        scratch.append(ends)
        found.append(ends.filter("low = high").select("key", "k", (F.col("low") + (F.col("before") + F.col("s") - F.col("rest") <= F.col("rest") - F.col("before")).cast("long")).alias("end")))
        todo = ends.filter("low < high").select("key", "k", "rest", "before", "parent")
        if todo.isEmpty():
            break
        level_rows = saved(level_rows.withColumn("parent", prefix).join(todo.select("key", "parent").distinct(), ["key", "parent"], "left_semi").select("key", "size", "place"))
        scratch.append(level_rows)
    ends = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "end"))).alias("ends"))  # an entry for each share
    until = F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda k: F.coalesce(F.try_element_at("ends", k), F.lit(0)))
    done = saved(aims.join(ends, "key", "left").withColumn("until", until).drop("ends"))
    discard(aims, *scratch)
    return done


def _times(k: int) -> Column:
    return F.col("passes")[k] + (F.col("place") < F.col("until")[k]).cast("long")


def taken(rows: DataFrame, limits: DataFrame, k: int = 0) -> DataFrame:
    """``measured`` rows with their source's size and target and the words taken of each, for the ``k``-th share: doc_id, source, size, source_size, target, taken.

    A null source is a source of its own; texts without words take nothing; repeated rows are documents of their own; no rows give no rows.
    """
    right = limits.select("key", "source_size", "targets", "passes", "until")
    both = settled_join(rows.withColumn("key", _source_key(F.col("source"))), right, "key")
    return both.select("doc_id", "source", "size", "source_size", F.col("targets")[k].alias("target"), (F.col("size") * _times(k)).alias("taken"))


def mixed(docs: DataFrame, limits: DataFrame, k: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the ``k``-th share takes it; documents without words come as often as others of their place."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(doc.alias("doc"), _source_key(F.col("source")).alias("key"), _place(F.col("doc_id"), F.col("text")).alias("place"))
    both = settled_join(rows, limits.select("key", "passes", "until"), "key")
    return both.withColumn("times", F.explode(F.array_repeat(F.lit(0), _times(k).cast("int")))).select("doc.*")

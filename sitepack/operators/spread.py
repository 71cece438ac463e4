"""Joins and running sums that one large site does not send to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import BROADCAST_ROWS, by_shuffle, saved

#: A table of too many rows to be broadcast is copied so many times, and the join deals rows to copies.
COPIES = 32


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` of which one may hold most of ``left``; ``right`` (saved, a few short columns) has a row for each key.

    A small ``right`` is broadcast; else each of its rows is copied and the left rows are dealt to the copies by their other columns.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    salt = F.pmod(F.xxhash64(*[c for c in left.columns if c not in keys]), F.lit(COPIES)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return left.withColumn("_salt", salt).join(by_shuffle(copies), [*keys, "_salt"], how).drop("_salt")


def running_sum(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over all rows that come earlier in the total ``order``.

    One sort over all partitions, sums within each, and a sum over the partitions' sums, of which there are as many as partitions.
    """
    sorted_rows = saved(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_value", value.cast("long")))
    part = F.shiftright("_at", 33)
    sums = sorted_rows.groupBy(part.alias("_part")).agg(F.sum("_value").alias("_sum"))
    earlier = saved(sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_earlier")))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy("_at")) - F.col("_value")
    both = sorted_rows.withColumn("_part", part).withColumn("_inside", inside).join(F.broadcast(earlier), "_part")
    return both.withColumn("before", F.col("_earlier") + F.col("_inside")).drop("_at", "_value", "_part", "_inside", "_earlier")

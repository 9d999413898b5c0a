"""Ranks within groups that hold for groups of any size.

No window here spans the rows of a group. Rows are first counted by distinct value (or by minute), with
map-side combine; running sums go over buckets of those counts, and the ranks are joined back by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def value_counts(df: DataFrame, group: str, value: str, *extra) -> DataFrame:  # noqa: ANN002
    """(group, value, _c and the ``extra`` aggregates, _below, _n): distinct values with the number of rows under each and in the group."""
    hist = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"), *extra)
    span = hist.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    width = F.greatest(F.col("_hi").cast("double") - F.col("_lo"), F.lit(1e-300))
    hist = hist.join(span, group).withColumn("_b", F.floor((F.col(value).cast("double") - F.col("_lo")) / width * (BUCKETS - 1)).cast("int"))
    buckets = hist.groupBy(group, "_b").agg(F.sum("_c").alias("_bc"))
    before = F.sum("_bc").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(group, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_c").over(Window.partitionBy(group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return hist.join(buckets, [group, "_b"]).withColumn("_below", F.col("_before") + F.coalesce(within, F.lit(0))).drop("_b", "_lo", "_hi", "_before")


def average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the 0-based average rank of ``value`` within its group, ties sharing their mean. Null values have none."""
    ranks = value_counts(df.where(F.col(value).isNotNull()), group, value).select(group, value, (F.col("_below") + (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, [group, value], "left")


def rank_percentile(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the average rank over max(1, n - 1): 0 for the least and 1 for the largest value if neither is tied."""
    ranks = value_counts(df, group, value).select(group, value, ((F.col("_below") + (F.col("_c") - 1) / 2) / F.greatest(F.lit(1), F.col("_n") - 1)).alias(name))
    return df.join(ranks, [group, value])


def timeline_position(df: DataFrame, group: str, at: str, tie: str, name: str) -> DataFrame:
    """``df`` with the place in time, i / max(1, n - 1); equal times go by ``tie``.

    Rows are counted by minute; only those of one minute of one group are ordered in one task.
    """
    timed = df.withColumn("_minute", F.floor(F.unix_micros(at) / 60_000_000))
    minutes = timed.groupBy(group, "_minute").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    minutes = minutes.select(group, "_minute", F.coalesce(F.sum("_c").over(w.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    place = F.row_number().over(Window.partitionBy(group, "_minute").orderBy(at, tie)) - 1
    placed = timed.withColumn("_i", place).join(minutes, [group, "_minute"])
    return placed.withColumn(name, (F.col("_before") + F.col("_i")) / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_minute", "_i", "_before", "_n")

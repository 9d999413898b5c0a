"""Descriptive tables of heavy-tailed engagement counts. All are one or two aggregations with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    return F.round(x, 6)


def decile(position: Column) -> Column:
    return F.least(F.lit(10), F.floor(position * 10) + 1).cast("int")


def age_bucket(age_h: Column) -> Column:
    """1 to 6: under an hour, to 6 h, to a day, to a week, to 30 days, over. Null and negative ages count as under an hour."""
    a = F.coalesce(age_h, F.lit(0.0))
    return F.when(a < 1, 1).when(a < 6, 2).when(a < 24, 3).when(a < 168, 4).when(a < 720, 5).otherwise(6)


def by_decile(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys, decile(F.col("age_pct")).alias("decile")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.log1p("like_count"))).alias("mean_log1p"))


def by_age_bucket(df: DataFrame) -> DataFrame:
    out = df.groupBy(age_bucket(F.col("age_h")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.log1p("like_count"))).alias("mean_log1p"), r6(F.avg("like_count")).alias("mean_likes"), r6(F.avg((F.col("like_count") == 0).cast("double"))).alias("zero_rate"))
    # Six rows: the share needs no pass of its own.
    return out.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def percentiles(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """(p, value): linear-interpolated percentiles, and p = 1 for the maximum."""
    q = df.agg(F.percentile(column, F.array(*map(F.lit, at))).alias("q"), F.max(column).cast("double").alias("m"))
    return q.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, [*at, 1.0])), F.concat("q", F.array("m")))).alias("p", "value")).select("p", r6(F.col("value")).alias("value"))


def top_share(df: DataFrame, column: str, share: float) -> DataFrame:
    """What part of the column's sum its largest ``share`` of rows hold. Rows are counted by value first; the running sum goes over distinct values."""
    hist = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = hist.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"))
    above = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.ceil(F.col("n") * share) - F.col("above")))
    return hist.withColumn("above", above).crossJoin(F.broadcast(total)).agg(F.max("n").alias("n"), r6(F.try_divide(F.sum(taken * F.col("v")), F.max("s"))).alias("top_share"))


def channel_profile(df: DataFrame, channel: str) -> DataFrame:
    return df.groupBy(channel).agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("like_count") == 0).cast("double"))).alias("zero_rate"), r6(F.avg("like_count")).alias("mean_likes"))


def like_tier(likes: Column) -> Column:
    return F.when(likes == 0, "0").when(likes < 10, "1-9").when(likes < 100, "10-99").when(likes < 1000, "100-999").otherwise("1000+")

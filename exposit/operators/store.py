"""The collection store as plans over append-only observations: upserts, work queue, quota, exclusions.

Nothing is updated in place. An observation log is appended to; current state is an aggregate over it, combined on the map side, so a
replayed page changes nothing and history is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """(keys, keep) of each key's largest row by ``order``, nulls smallest."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_m")).select(*keys, *[F.col("_m")[c].alias(c) for c in keep])


def upsert(log: DataFrame, key: str, order: list[str], mutable: list[str], fixed: list[str]) -> DataFrame:
    """One row per key: ``mutable`` columns of its last observation (a null there stays null), ``fixed`` ones of its first."""
    last, first = (f(F.struct(*order, *[c for c in cols if c not in order])) for f, cols in ((F.max, mutable), (F.min, fixed)))
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_l"), first.alias("_f")).select(key, *[F.col("_f")[c].alias(c) for c in fixed], *[F.col("_l")[c].alias(c) for c in mutable])


def insert_new(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What of ``new`` isn't stored yet, once per key; a stored row is never replaced."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def work_queue(videos: DataFrame) -> DataFrame:
    """Open videos: begun ones first, then the fewest comments (unknown before all), then by id."""
    return videos.where(F.col("status").isin("in_progress", "pending")).orderBy((F.col("status") != "in_progress").cast("int"), F.col("comment_count").asc_nulls_first(), "video_id")


def next_video(videos: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The first of the queue. Failed videos are taken up again only if asked for."""
    if retry_failed:
        videos = videos.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))
    return work_queue(videos).limit(1)


def summary(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """One row: videos by status, comments, and videos that have any."""
    v = videos.groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("status", F.lit("?")).alias("status"), "n"))).alias("s"))
    by = v.select(F.concat_ws(",", F.transform("s", lambda x: F.concat_ws("=", x["status"], x["n"].cast("string")))).alias("videos"))
    return by.crossJoin(comments.agg(F.count(F.lit(1)).alias("comments"), F.count_distinct("video_id").alias("videos_with_comments")))


def quota(ledger: DataFrame, budget: int) -> DataFrame:
    """(day, used, remaining, can_spend_one) from additive ledger rows; unknown units count as 0."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    used = ledger.where("day_pt is not null").groupBy(F.col("day_pt").alias("day")).agg(F.sum(F.coalesce("units_used", F.lit(0))).alias("used"))
    return used.select("day", "used", F.greatest(F.lit(0), budget - F.col("used")).alias("remaining"), (F.col("used") < budget).alias("can_spend"))


def spend(ledger: DataFrame, day: str, units: int, budget: int) -> DataFrame:
    """The ledger with an additive row; refuses what the day's budget doesn't hold."""
    if units < 0:
        raise ValueError("units can't be negative")
    used = ledger.where(F.col("day_pt") == day).agg(F.coalesce(F.sum("units_used"), F.lit(0))).collect()[0][0]
    if used + units > budget:
        raise RuntimeError(f"{used} of {budget} units are used on {day}")
    return ledger.select("day_pt", "units_used").union(ledger.sparkSession.createDataFrame([(day, units)], "day_pt string, units_used bigint"))


def exclusions(videos: DataFrame, least: int, most: int, cap: int) -> DataFrame:
    """``videos`` with ``reason``: no_comment_count, too_few, too_many, over_channel_cap (the first that holds), or 'included'.

    The cap keeps the first videos of a channel by id among those that pass the rest: a ranked group limit, so no channel is held whole.
    """
    n = F.col("comment_count")
    first = F.when(n.isNull(), "no_comment_count").when(n < least, "too_few").when(n > most, "too_many")
    marked = videos.withColumn("reason", first)
    kept = marked.where("reason is null").select("channel_id", "video_id")
    w = Window.partitionBy("channel_id").orderBy("video_id")
    within = kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).select("video_id", F.lit("included").alias("_in"))
    return marked.join(within, "video_id", "left").withColumn("reason", F.coalesce("reason", "_in", F.lit("over_channel_cap"))).drop("_in")


def relevance(pages: DataFrame) -> DataFrame:
    """(video_id, comment_id, rank) from probes (video_id, ids array, fetched_at): 1-based places, the last probe of each comment; ids that left the page stay."""
    rows = pages.select("video_id", "fetched_at", F.posexplode("ids").alias("_p", "comment_id")).withColumn("rank", F.col("_p") + 1)
    return last_by(rows, ["video_id", "comment_id"], ["fetched_at", "rank"], ["rank"])

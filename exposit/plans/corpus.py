"""The corpus as the operators see it: one current row per comment and video, and the feature base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposit.functions import scalars as X
from exposit.operators import ranks
from exposit.sources.tables import load

MIN_COMMENTS = 20


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is largest by ``order``, nulls smallest. Combined on the map side; rows of a hot key never meet in full."""
    rest = [c for c in df.columns if c not in (key, *order)]
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return top.select(key, *[F.col("_m")[c].alias(c) for c in df.columns if c != key])


def comments(spark: SparkSession, d: str) -> DataFrame:
    return latest(load(spark, d, "comments"), "comment_id", ["fetched_at", "like_count", "reply_count", "updated_at"])


def videos(spark: SparkSession, d: str) -> DataFrame:
    """The first crawl of each video: what is stored already isn't replaced."""
    raw = load(spark, d, "videos")
    first = raw.withColumn("_f", -F.coalesce(F.unix_micros("stats_fetched_at"), F.lit(2**62)))
    return latest(first, "video_id", ["_f", "view_count", "channel_handle"]).drop("_f")


COMMENTS_SQL = """cc AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY fetched_at DESC NULLS LAST, like_count DESC NULLS LAST, reply_count DESC NULLS LAST, updated_at DESC NULLS LAST) k FROM comments WHERE comment_id IS NOT NULL) WHERE k = 1)"""
VIDEOS_SQL = """cv AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY stats_fetched_at ASC NULLS LAST, view_count DESC NULLS LAST, channel_handle DESC NULLS LAST) k FROM videos WHERE video_id IS NOT NULL) WHERE k = 1)"""


def base(spark: SparkSession, d: str, least: int = MIN_COMMENTS) -> DataFrame:
    """Comments of finished videos with at least ``least`` of them, joined with their video; age in hours."""
    c = comments(spark, d).select("comment_id", "video_id", "text", "like_count", F.col("published_at").alias("at"))
    v = videos(spark, d).where("status = 'done'").select("video_id", F.coalesce("channel_handle", F.lit("?")).alias("channel"), F.col("published_at").alias("video_at"), "duration", "view_count", "comment_count")
    both = c.where("at is not null").join(v, "video_id")
    enough = both.groupBy("video_id").count().where(F.col("count") >= least).select("video_id")
    return both.join(enough, "video_id", "left_semi").withColumn("age_h", X.hours_between(F.col("at"), F.col("video_at")))


BASE_SQL = f"""WITH {COMMENTS_SQL}, {VIDEOS_SQL},
b0 AS (SELECT c.comment_id, c.video_id, c.text, c.like_count, c.published_at AS at_time, coalesce(v.channel_handle, '?') AS channel, v.duration, v.view_count, v.comment_count,
       (epoch_us(c.published_at) - epoch_us(v.published_at)) / 3.6e9 AS age_h
       FROM cc c JOIN cv v USING (video_id) WHERE v.status = 'done' AND c.published_at IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY at_time, comment_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM b0),
f AS (SELECT *, i / greatest(1, n - 1) AS age_pct,
      (rank() OVER (PARTITION BY video_id ORDER BY like_count) - 1 + (count(*) OVER (PARTITION BY video_id, like_count) - 1) / 2.0) / greatest(1, n - 1) AS y
      FROM b WHERE n >= {MIN_COMMENTS})"""


def positioned(spark: SparkSession, d: str) -> DataFrame:
    return ranks.timeline_position(base(spark, d), "video_id", "at", "comment_id", "age_pct")


def featured(spark: SparkSession, d: str) -> DataFrame:
    """The feature base: position, target and the columns that features are made of."""
    return ranks.rank_percentile(positioned(spark, d), "video_id", "like_count", "y")

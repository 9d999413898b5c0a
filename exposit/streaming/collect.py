"""Collecting pages as a stream into an append-only observation log.

Each micro-batch writes its own folder of the log, named by batch id and overwritten if the batch runs again, so a restart
after a lost executor or driver neither loses nor doubles observations. Quota is spent in a ledger folder before the page's
rows are written: a crash in between over-counts a batch at most, and never spends unrecorded units. State is an aggregate over the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposit.operators import store
from exposit.sources.pages import parse_threads


def collect(pages: DataFrame, folder: str, budget: int | None = None) -> None:
    """Takes all available ``pages`` (video_id, page json, fetched_at) into ``folder``/log and ``folder``/ledger.

    A page costs one unit. Beyond ``budget`` units a batch's further pages go to ``folder``/paused untouched, by order of video and page; the next call takes them
    up first, with its own budget.
    """
    spark = pages.sparkSession

    before = _units(spark, folder)
    waiting = _paused(spark, folder)

    def take(batch: DataFrame, name: str) -> None:
        batch = batch.persist()
        units = batch.count()
        if budget is not None and units > (left := max(0, budget - (_units(spark, folder, but=name) - before))):
            # All pages up to the last one that the budget holds; a page that occurs twice is one page.
            place = F.struct("video_id", "page")
            last = batch.select(place.alias("p")).orderBy("p").limit(left).agg(F.max("p")).collect()[0][0]
            within = place <= F.struct(F.lit(last[0]), F.lit(last[1])) if last else F.lit(False)
            batch.where(~within).write.mode("overwrite").parquet(f"{folder}/paused/batch={name}")
            taken, units = batch.where(within), left
        else:
            taken = batch
        spark.createDataFrame([(units,)], "units_used bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/batch={name}")
        _parsed(taken).write.mode("overwrite").parquet(f"{folder}/log/batch={name}")
        batch.unpersist()

    for name, path in waiting:
        take(spark.read.parquet(path), f"{name}r")
        _remove(spark, path)
    query = pages.writeStream.foreachBatch(lambda df, k: take(df, str(k))).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _parsed(batch: DataFrame) -> DataFrame:
    """Rows of the pages with their video and time of fetching."""
    one = batch.select(F.col("page"), F.struct("video_id", "fetched_at").alias("_of"))
    exploded = parse_threads(one, "page", keep=["_of"])
    return exploded.select("_of.video_id", "_of.fetched_at", *[c for c in exploded.columns if c != "_of"])


def _units(spark, folder: str, but: str | None = None) -> int:  # noqa: ANN001
    """Units spent so far, without those of a batch that runs again."""
    from pyspark.errors import AnalysisException

    try:
        ledger = spark.read.option("basePath", f"{folder}/ledger").schema("units_used bigint, batch string").parquet(f"{folder}/ledger")
        return ledger.where(F.col("batch") != (but or "")).agg(F.coalesce(F.sum("units_used"), F.lit(0))).collect()[0][0]
    except AnalysisException:
        return 0


def _paused(spark, folder: str) -> list[tuple[str, str]]:  # noqa: ANN001
    """(batch name, folder) of the pages that wait for budget."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/paused")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((x.getPath().getName().removeprefix("batch="), x.getPath().toString()) for x in fs.listStatus(at)) if fs.exists(at) else []


def _remove(spark, path: str) -> None:  # noqa: ANN001
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def state(folder: str, spark) -> DataFrame:  # noqa: ANN001
    """The stored comments: fixed columns of the first observation, counts of the last."""
    log = spark.read.parquet(f"{folder}/log")
    return store.upsert(log, "comment_id", ["fetched_at", "like_count", "reply_count"], ["like_count", "reply_count", "fetched_at"], ["video_id", "author_channel_id", "text", "published_at"])


def windowed(events: DataFrame, at: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window with a watermark; an addition for monitoring a collection."""
    return events.withWatermark(at, late).groupBy(F.window(at, every)).agg(F.count(F.lit(1)).alias("n"))

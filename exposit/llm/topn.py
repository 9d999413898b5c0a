"""The N first items of every group, with statistics-guided skipping.

The items are written clustered by group, best first, as Parquet files with small row groups in the
shared folder. A reader opens a file's footer, takes its row groups in descending maximum score, and
skips those whose maximum lies strictly below the current N-th score of every group they contain.
Equal scores are read, since the tie rule may still prefer them. What a row group contains is
known from its group minimum and maximum: as the file is sorted by group, one with two groups or more
holds the beginning of a group not seen before, which has no N-th score yet, and is read.

A hot group is spread over several files by a salt that follows its counted size; every file gives at most N of
it, and the last merge sees at most N times the number of its salts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposit.sources.tables import drop, listing, scratch, written

FILE_ROWS = 200_000
ROW_GROUP_BYTES = 192 << 10


def read_top(path: str, n: int) -> tuple[pd.DataFrame, int, int]:
    """The first ``n`` of each group in a file; how many row groups were read, and how many there are."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        names = file.schema_arrow.names
        parts = []
        for i in range(file.num_row_groups):
            meta = file.metadata.row_group(i)
            group, score = (meta.column(names.index(c)).statistics for c in ("_g", "_s"))
            known = group is not None and score is not None and group.has_min_max and score.has_min_max
            # The file is sorted by group, so a row group of two groups or more holds the start of one not seen yet.
            parts.append((-score.max, i, group.min) if known and group.min == group.max else (-math.inf, i, None))
        # Only a group that has row groups of its own can have one skipped, so only its N-th score is followed.
        scores: dict[str, np.ndarray] = {only: np.empty(0, np.int64) for _, _, only in parts if only is not None}
        kept, read = [], 0
        for top, i, only in sorted(parts):
            held = scores.get(only, ())
            if len(held) == n and -top < held.min():
                continue
            read += 1
            pdf = file.read_row_group(i).to_pandas()
            pdf = pdf[pdf.groupby("_g", sort=False).cumcount() < n]
            kept.append(pdf)
            for g in scores.keys() & set(pdf["_g"].unique()) if scores else ():
                both = np.append(scores[g], pdf["_s"].to_numpy()[pdf["_g"] == g])
                scores[g] = np.partition(both, len(both) - n)[-n:] if len(both) > n else both
    if not kept:
        return pd.DataFrame(columns=["_g", "_s", "_t", "_i"]), read, len(parts)
    every = pd.concat(kept).sort_values(["_g", "_s", "_t", "_i"], ascending=[True, False, True, True])
    return every[every.groupby("_g", sort=False).cumcount() < n], read, len(parts)


def top_n(df: DataFrame, group: str, score: str, tie: str, item: str, n: int, file_rows: int = FILE_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """(group, item, score, rank int): the ``n`` first rows of each group, by score descending, then ``tie``, then item ascending.

    Rows without a group or item are left out. A null score comes last, as does a null tie value within its score.
    Repeated rows count as often as they occur. An empty table gives no rows. ``group`` and ``item`` come out as strings,
    ``score`` as bigint; other columns are ignored whatever their names. ``sizes`` is (group, count) with no fewer rows than a group has, where
    that is cheap to tell; else ``df`` is written once more to be counted.
    """
    spark = df.sparkSession
    at = F.coalesce(F.unix_micros(F.col(tie)), F.lit(2**63 - 1)) if dict(df.dtypes)[tie] == "timestamp" else F.coalesce(F.col(tie).cast("bigint"), F.lit(2**63 - 1))
    rows = df.select(F.col(group).cast("string").alias("_g"), F.coalesce(F.col(score).cast("bigint"), F.lit(-(2**63))).alias("_s"), at.alias("_t"), F.col(item).cast("string").alias("_i"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_i").isNotNull())
    copy = None
    if sizes is None:
        rows = copy = written(rows, "rows")
        sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("count"))
    sizes = sizes.toDF("_g", "_c")
    total = sizes.agg(F.coalesce(F.sum("_c"), F.lit(0))).collect()[0][0]
    hot = sizes.where((F.col("_c") > file_rows) & F.col("_g").isNotNull()).select(F.col("_g").cast("string").alias("_g"), F.ceil(F.col("_c") / file_rows).cast("int").alias("_salts"))
    files = max(1, math.ceil(total / file_rows))
    # At most total / file_rows groups are hot; the join is left to the size that Spark finds at run time.
    salted = rows.join(hot, "_g", "left").withColumn("_x", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_i"), F.col("_salts"))).cast("int"))
    clustered = scratch(spark, "topn")
    salted.repartition(max(files, min(4 * files, spark.sparkContext.defaultParallelism)), "_g", "_x").select("_g", "_s", "_t", "_i").sortWithinPartitions("_g", F.desc("_s"), "_t", "_i").write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(clustered)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                best, _, _ = read_top(path, n)
                yield best

    if copy is not None:
        drop(spark, copy)
    paths = listing(spark, clustered)
    schema = "_g string, _s bigint, _t bigint, _i string"
    if not paths:
        found = spark.createDataFrame([], schema)
    else:
        at_once = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
        found = at_once.mapInPandas(run, schema)
    order = Window.partitionBy("_g").orderBy(F.desc("_s"), "_t", "_i")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), F.when(F.col("_s") > -(2**63), F.col("_s")).alias(score), "rank")


def latest_observation(comments: DataFrame) -> DataFrame:
    """One row per comment_id: what was last fetched of it. A tie of fetched_at goes to the larger like count."""
    last = F.max(F.struct("fetched_at", "like_count", "video_id", "published_at")).alias("_o")
    return comments.where(F.col("comment_id").isNotNull()).groupBy("comment_id").agg(last).select("comment_id", "_o.video_id", "_o.like_count", "_o.published_at")

"""Nearest-neighbour engagement estimates: every query against the whole reference, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(df: DataFrame, key: str, vector: str, extra: str, many: int, name: str) -> DataFrame:
    """Rows packed into ``many`` blocks of about ``BLOCK``, so that a task holds two blocks at a time."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(extra).cast("double").alias("x"))
    return rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(many)).cast("int").alias(name)).agg(F.collect_list("k").alias(f"{name}_k"), F.collect_list("v").alias(f"{name}_v"), F.collect_list("x").alias(f"{name}_x"))


def nearest(queries: DataFrame, reference: DataFrame, key: str, vector: str, likes: str, k: int, skip_self: bool = False) -> DataFrame:
    """(query, ref, dot, likes, rank): the ``k`` nearest by dot product, ties by the reference's key. Null vectors take no part.

    Each pair of blocks is one matrix product and gives k rows per query; the last top-k merges (number of reference blocks) * k rows per query.
    Raises if the reference has fewer than ``k`` rows.
    """
    queries, reference = queries.where(F.col(vector).isNotNull()), reference.where(F.col(vector).isNotNull())
    n_ref, n_q = reference.count(), queries.count()
    if n_ref < k + skip_self:
        raise ValueError(f"{k} neighbours of {n_ref} rows")
    nr, nq = math.ceil(n_ref / BLOCK), max(1, math.ceil(n_q / BLOCK))
    q = _blocks(queries, key, vector, likes, nq, "q").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    pairs = q.join(_blocks(reference, key, vector, likes, nr, "r"), "r")
    kind = queries.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                a, b = (np.stack([np.asarray(v, np.float64) for v in x]) for x in (row.q_v, row.r_v))
                qk, rk, likes_of = np.asarray(row.q_k), np.asarray(row.r_k), np.asarray(row.r_x)
                dots = a @ b.T
                if skip_self:
                    dots[qk[:, None] == rk[None, :]] = -np.inf
                # By dot, then key: the keys' order decides between equal dots.
                order = np.lexsort((np.broadcast_to(rk, dots.shape), -dots), axis=1)[:, :k]
                at = np.arange(len(qk))[:, None]
                out = pd.DataFrame({"query": np.repeat(qk, order.shape[1]), "ref": rk[order].ravel(), "dot": dots[at, order].ravel(), "likes": likes_of[order].ravel()})
                yield out[np.isfinite(out["dot"])]

    found = pairs.select("q_k", "q_v", "r_k", "r_v", "r_x").mapInPandas(run, f"query {kind}, ref {kind}, dot double, likes double")
    w = Window.partitionBy("query").orderBy(F.desc("dot"), "ref")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def estimates(neighbours: DataFrame, k: int) -> DataFrame:
    """(query, estimate): the mean likes of the first k neighbours."""
    return neighbours.where(F.col("rank") <= k).groupBy("query").agg(F.avg("likes").alias("estimate"))


def mean_pairwise_cosine(df: DataFrame, vector: str, group: str | None = None) -> DataFrame:
    """(n, mean_cosine) over all pairs of unit vectors, in one pass: (|sum|^2 - sum of |v|^2) / (n (n - 1)); null for fewer than two."""
    keys = [group] if group else []
    long = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("_p", "_v")).withColumn("_v", F.col("_v").cast("double"))
    parts = long.groupBy(*keys, "_p").agg(F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    n = F.max("_n")
    return parts.groupBy(*keys).agg(n.alias("n"), F.round(F.try_divide(F.sum(F.col("_s") * F.col("_s")) - F.sum("_q"), (n * (n - 1)).cast("double")), 6).alias("mean_cosine"))

"""Packing items of varying length into containers of fixed capacity, balanced by attention cost.

The cost of an item of n tokens is ``linear * n + quadratic * n^2``: what the layers and the attention
over it take. Items go in descending length to the sequence of lowest cost so far that still has room;
a new one is opened only if none has. ``ceil(tokens / capacity)`` sequences are open from the start,
so that the costs are balanced, and the many short items that come last fill what is left.

An item longer than the capacity is cut into full containers and one remainder, which is packed like
any other item. Items of length 0 (null or empty text) take no room: container null, piece 0.
Scale: items are dealt by a hash of their row into shards of about ``shard_items``, so repeated keys don't gather in one; a shard holds lengths and ids
only, is packed in one task, and its container ids begin with the shard's number. What a shard wastes is less than a few
containers, so whole results stay near the bound at any size.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposit.sources.tables import cut

CAPACITY = 2048
SHARD_ITEMS = 40_000


def pack(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item and its offset there. ``lengths`` is descending, each in 1..capacity."""
    open_at = max(1, math.ceil(int(lengths.sum()) / capacity))
    room = [capacity] * open_at
    heap = [(0.0, b) for b in range(open_at)]
    cost = [0.0] * open_at
    parked: dict[int, list[int]] = {}
    last = capacity + 1
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        while last > n:  # sequences that were too full for longer items have room again
            last -= 1
            for b in parked.pop(last, ()):
                heapq.heappush(heap, (cost[b], b))
        while heap and room[heap[0][1]] < n:
            b = heapq.heappop(heap)[1]
            parked.setdefault(room[b], []).append(b)
        if heap:
            b = heapq.heappop(heap)[1]
        else:
            b = len(room)
            room.append(capacity)
            cost.append(0.0)
        where[i], offset[i] = b, capacity - room[b]
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n
        if room[b]:
            heapq.heappush(heap, (cost[b], b))
    return where, offset


def pack_items(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 4096, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, piece int, start int, length int, container string, offset int) for every item.

    Each row of ``sizes`` is an item; repeated keys and null keys are items of their own, and no two full pieces share a container. A null size
    counts as 0, a null key is kept. Ties of length go by key. No rows in, no rows out.
    """
    kind = sizes.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    full = F.expr(f"if(_n <= {capacity}, 0, floor(_n / {capacity}))")
    base = sizes.select(F.col(key).alias("_k"), n.alias("_n")).withColumn("_full", full.cast("int"))
    # A number of the row, not of the key: keys may repeat. The checkpoint below fixes it.
    base = base.withColumn("_h", F.monotonically_increasing_id())
    pieces = base.select("_k", "_n", "_full", "_h", F.explode(F.expr(f"sequence(0, if(_n > {capacity} and _n % {capacity} = 0, _full - 1, _full))")).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select("_k", "_h", "piece", start.cast("int").alias("start"), F.least(F.lit(capacity), F.col("_n") - start).cast("int").alias("length"))
    pieces = cut(pieces)
    rest = (F.col("length") > 0) & (F.col("length") < capacity)
    count = pieces.where(rest).count()
    shards = max(1, math.ceil(count / shard_items))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_k", "piece"], ascending=[False, True, True], kind="stable")
        where, offset = pack(pdf["length"].to_numpy(np.int64), capacity, linear, quadratic)
        names = np.char.add(f"s{int(pdf['_shard'].iloc[0])}-", where.astype(str))
        return pd.DataFrame({key: pdf["_k"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "container": names, "offset": offset})

    schema = f"`{key}` {kind}, piece int, start int, length int, container string, offset int"
    packed = pieces.where(rest).withColumn("_shard", F.pmod(F.xxhash64("_h"), F.lit(shards))).groupBy("_shard").applyInPandas(run, schema)
    alone = pieces.where(~rest).select(F.col("_k").alias(key), "piece", "start", "length", F.when(F.col("length") > 0, F.concat(F.lit("f"), F.hex("_h"), F.lit("-"), F.col("piece").cast("string"))).alias("container"), F.lit(0).alias("offset"))
    return packed.unionByName(alone)

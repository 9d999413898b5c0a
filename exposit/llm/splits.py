"""Splits that keep related records together.

Records are linked by the identifiers that occur together in a row. Components come from Borůvka
contraction: in every round each component picks its minimum outgoing edge in one fixed total order, so
the picked edges form no cycle; they are added to the spanning forest, the components they join are
contracted to their smallest node by pointer jumping, and the rest of the edges are relabelled. The number
of components with an outgoing edge at least halves a round. Each round's part of the forest is written to a table in the shared folder; labels come from
that table.

Rows are first reduced to distinct identifier pairs with map-side combine, so a creator with a third of all
rows is a handful of edges. Labels move along edges only: no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposit.sources.tables import cut, scratch

#: What stands for a missing identifier.
PLACEHOLDERS = ("", "-", "--", "?", "0", "n/a", "na", "nan", "none", "null", "nil", "unknown", "undefined", "missing", "tbd", "deleted", "placeholder")
#: Fixed value: a channel id by its published form; shorter test ids are accepted too.
CHANNEL_ID = r"^UC[0-9A-Za-z_-]{6,}$"


def usable_channel(raw: Column) -> Column:
    """The channel id, or null where it is missing, blank, a placeholder or not of a channel id's form."""
    own = F.regexp_replace(raw, r"[\s\p{Z}\p{Cf}]+", "")
    return F.when(own.rlike(CHANNEL_ID), own)


def canonical_handle(raw: Column) -> Column:
    """One spelling of a handle: lower case, no '@', invisible characters, white space, address or percent code around it.

    Other visible letters, digits, '.' and '_' make another handle. Null where nothing or a placeholder is left.
    """
    folded = F.translate(raw, "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)))
    coded = F.regexp_replace(folded, r"%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.try_url_decode(F.regexp_replace(coded, r"\+", "%2B"))
    bare = F.lower(F.regexp_replace(F.coalesce(plain, folded), r"[\s\p{Z}\p{C}\p{Mn}]+", ""))
    # An address: what follows its first '@', or else its last part; then no path, query or fragment.
    tail = F.when(bare.contains("/@"), F.regexp_extract(bare, r"/@([^/?#]*)", 1)).when(bare.rlike(r"^(https?:)?//|^[a-z0-9.-]+/"), F.regexp_extract(bare, r"^(?:https?:)?(?://)?[^/?#]+/(?:c/|user/|channel/)?([^/?#]*)", 1)).otherwise(F.regexp_replace(bare, r"[/?#].*$", ""))
    name = F.regexp_replace(tail, r"^@+", "")
    return F.when(~name.isin(*PLACEHOLDERS) & ~bare.isin(*PLACEHOLDERS), name)


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(labels (node, root), forest (a, b, round, picker, root)) of an undirected graph; root is the component's smallest node.

    The forest is a table in the shared folder, a folder per round: each component ``picker`` of the round with the edge it picked and the component
    ``root`` it became part of; a null edge is that of a component whose edge the other end has. Labels are read off this table.
    Rows with a null end are ignored; loops and repeated edges change nothing. No edges, no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    ordered = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    table, schema = scratch(spark, "forest"), "a string, b string, picker string, root string"
    # An edge's place in the total order is (weight, a, b); the ends' names decide between equal weights.
    open_edges = ordered.where("a <> b").select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"), F.xxhash64("a", "b").alias("w"))
    parts: list[DataFrame] = []
    for k in range(rounds):
        open_edges = cut(open_edges)
        if open_edges.isEmpty():
            break
        both = open_edges.select(F.explode(F.array(F.struct(F.col("ra").alias("r"), F.struct("w", "a", "b", F.col("rb").alias("to")).alias("e")), F.struct(F.col("rb").alias("r"), F.struct("w", "a", "b", F.col("ra").alias("to")).alias("e")))).alias("x")).select("x.*")
        picked = cut(both.groupBy("r").agg(F.min("e").alias("e")).select("r", "e.a", "e.b", "e.to"))
        # Both ends of a component pair may pick the same edge: the smaller then stays a root.
        back = picked.select(F.col("r").alias("to"), F.col("to").alias("r2"))
        twice = (F.col("r2") == F.col("r")) & (F.col("r") < F.col("to"))
        linked = cut(picked.join(back, "to", "left").select("r", "a", "b", F.when(twice, F.col("r")).otherwise(F.col("to")).alias("up")))
        hooks = linked.select("r", "up")
        while True:
            above = hooks.select(F.col("r").alias("up"), F.col("up").alias("top"))
            jumped = cut(hooks.join(above, "up").select("r", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hooks, moved = jumped.select("r", "up"), not jumped.where("moved").isEmpty()
            if not moved:
                break
        # Contract to the smallest label, so that the root needs no second naming.
        least = hooks.groupBy("up").agg(F.min("r").alias("root"))
        kept = F.col("r") != F.col("up")
        own = linked.select("r", F.when(kept, F.col("a")).alias("a"), F.when(kept, F.col("b")).alias("b"))
        hooks.join(least, "up").select("r", "root").join(own, "r").select("a", "b", F.col("r").alias("picker"), "root").write.parquet(f"{table}/round={k}")
        parts.append(spark.read.schema(schema).parquet(f"{table}/round={k}"))
        names = parts[-1]
        left, right = names.select(F.col("picker").alias("ra"), F.col("root").alias("na")), names.select(F.col("picker").alias("rb"), F.col("root").alias("nb"))
        open_edges = open_edges.join(left, "ra", "left").join(right, "rb", "left").select("a", "b", F.coalesce("na", "ra").alias("ra"), F.coalesce("nb", "rb").alias("rb"), "w").where("ra <> rb")
    else:
        raise RuntimeError(f"not contracted after {rounds} rounds")
    labels = ordered.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    for part in parts:
        labels = labels.withColumnRenamed("root", "picker").join(part.select("picker", "root"), "picker", "left").select("node", F.coalesce("root", "picker").alias("root"))
    forest = spark.createDataFrame([], schema + ", round int")
    for k, part in enumerate(parts):
        forest = forest.unionByName(part.withColumn("round", F.lit(k)))
    return cut(labels), forest.select("a", "b", "round", "picker", "root")


def creator_groups(videos: DataFrame, channels: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups (video_id, group_key), forest): the group of every video_id in videos or comments.

    group_key is the smallest channel id of what is linked with the video through channel ids and handles; '@' and
    the smallest handle where that holds no channel id; the video_id itself where neither identifier of the video is usable.
    Null video ids are left out.
    """
    seen = videos.where("video_id is not null").select("video_id", usable_channel(F.col("channel_id")).alias("c"), canonical_handle(F.col("channel_handle")).alias("h")).distinct()
    seen = cut(seen)
    pairs = seen.select("c", "h").union(channels.select(usable_channel(F.col("channel_id")), canonical_handle(F.col("handle")))).distinct()
    # 'c' sorts before 'h', so the smallest node of a component is its smallest channel id.
    node = lambda kind, x: F.concat(F.lit(f"{kind}:"), F.col(x))
    channel, handle = node("c", "c"), node("h", "h")
    one = pairs.where("c is not null or h is not null").select(F.coalesce(channel, handle).alias("a"), F.coalesce(handle, channel).alias("b"))
    # A video seen with two identifiers that no single row joins still links them.
    by_video = seen.select("video_id", F.explode(F.array_compact(F.array(channel, handle))).alias("a")).groupBy("video_id").agg(F.min("a").alias("b"), F.max("a").alias("a"))
    every = seen.select("video_id", F.explode(F.array_compact(F.array(channel, handle))).alias("a")).distinct()
    linked = every.join(by_video.select("video_id", "b"), "video_id").select("a", "b").distinct()
    labels, forest = spanning_forest(one.union(linked))
    own = by_video.select("video_id", F.col("b").alias("node")).join(labels, "node").select("video_id", F.when(F.col("root").startswith("h:"), F.concat(F.lit("@"), F.expr("substring(root, 3)"))).otherwise(F.expr("substring(root, 3)")).alias("group_key"))
    ids = seen.select("video_id").union(comments.where("video_id is not null").select("video_id").distinct()).distinct()
    return ids.join(own, "video_id", "left").select("video_id", F.coalesce("group_key", "video_id").alias("group_key")), forest


#: A group is dealt by itself if its weight is over this part of the smallest split's share; that many at most: the number of such shares.
ALONE = 0.02


def deal(groups: DataFrame, weights: DataFrame, shares: dict[str, float], alone: float = ALONE) -> DataFrame:
    """(video_id, group_key, split): groups are dealt to splits so that each gets about its share of the weight.

    ``weights`` is (video_id, weight). Roots are stratified by size band (powers of two of their weight) and dealt systematically within their band: in
    hashed order, from a start that differs by band, a root of rank k takes the split that holds the k-th place of the shares.
    Stretches are hash buckets of a band, so no window holds a whole band of millions. Roots over ``alone`` of the smallest split's share
    would be too coarse for that: these, 1 / (alone * least share) at most at any size, go in descending order each to the split that lacks most,
    and the bands then deal by what the splits still lack.
    """
    spark = groups.sparkSession
    known = groups.join(weights, "video_id", "left")
    sizes = cut(known.groupBy("group_key").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("n")))
    names, total = list(shares), sum(shares.values())
    whole, many = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    want = {s: shares[s] / total * whole for s in names}
    got = dict.fromkeys(names, 0)
    over = F.col("n") > alone * min(want.values())
    first = []
    for row in sizes.where(over).orderBy(F.desc("n"), "group_key").collect():
        s = max(names, key=lambda x: want[x] - got[x])
        got[s] += row["n"]
        first.append((row["group_key"], s))
    lack = {s: max(0.0, want[s] - got[s]) for s in names}
    lack = lack if sum(lack.values()) else {s: shares[s] for s in names}
    band = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int")
    rest = sizes.where(~over).withColumn("band", band).withColumn("stretch", F.pmod(F.xxhash64("group_key"), F.lit(max(1, many // 50_000))))
    place = (F.row_number().over(Window.partitionBy("band", "stretch").orderBy(F.xxhash64(F.lit("deal"), F.col("group_key")), "group_key")) * 0.6180339887498949 + F.pmod(F.hash("band", "stretch"), F.lit(997)) / 997) % 1.0
    split, reached = F.lit(names[-1]), 0.0
    for s in reversed(names[:-1]):
        reached = sum(lack[x] for x in names[: names.index(s) + 1]) / sum(lack.values())
        split = F.when(place < reached, F.lit(s)).otherwise(split)
    dealt = spark.createDataFrame(first, "group_key string, split string").union(rest.select("group_key", split.alias("split")))
    return groups.join(dealt, "group_key").select("video_id", "group_key", "split")

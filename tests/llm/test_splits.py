from __future__ import annotations

import random
from collections import defaultdict

from exposit.llm import splits as S


def components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def test_forest_spans_the_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(80)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("n01", "n01"), ("n02", "n03"), ("n02", "n03")]
    labels, forest = S.spanning_forest(spark.createDataFrame(edges + [(None, "n05")], "a string, b string"))
    want = components(edges)
    labels_of = {r["node"]: r["root"] for r in labels.collect()}
    assert labels_of == want
    rows = forest.collect()
    tree = {(r["a"], r["b"]) for r in rows if r["a"]}
    assert all(labels_of[r["picker"]] == labels_of[r["root"]] for r in rows)
    assert components(tree | {(x, x) for x in want}) == want and len(tree) == len(want) - len(set(want.values()))


def test_no_edges(spark):
    labels, forest = S.spanning_forest(spark.createDataFrame([], "a string, b string"))
    assert labels.count() == 0 and forest.count() == 0


def test_handles_by_any_spelling(spark):
    same = ["@Zor.mir", " @zor.mir ", "\t@ZOR.MIR\xa0", "＠zor.mir", "%40zor.mir", "zor.mir", "@zo​r.mir", "@zor­.mir", "https://tube.example/@Zor.mir/videos", "http://m.tube.example/@zor.mir?si=x1", "tube.example/@zor.mir/"]
    other = ["@zormir", "@zor_mir", "@zor.mir2"]
    none = [None, "", "  ", "@", "n/a", "​"]
    rows = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(same + other + none)], "i int, h string").orderBy("i").select(S.canonical_handle(S.F.col("h"))).collect()]
    assert rows == ["zor.mir"] * len(same) + ["zormir", "zor_mir", "zor.mir2"] + [None] * len(none)


def test_groups_and_shares(spark):
    videos = spark.createDataFrame([("v1", "UCaaaaaaaa", "@one", 1), ("v2", None, " @ONE ", 1), ("v2", "n/a", "@one", 1), ("v3", "unknown", None, 1), ("v4", "UCbbbbbbbb", "", 1), ("v5", "UCbbbbbbbb", "@two", 1), (None, "UCzzzzzzzz", "@one", 1), ("v7", "", "@alone", 1)], "video_id string, channel_id string, channel_handle string, group_key int")
    channels = spark.createDataFrame([("UC00000000", "@two"), (None, None)], "channel_id string, handle string")
    comments = spark.createDataFrame([("v1", "c1"), ("v9", "c2"), (None, "c3")], "video_id string, comment_id string")
    groups, _ = S.creator_groups(videos, channels, comments)
    assert {r["video_id"]: r["group_key"] for r in groups.collect()} == {"v1": "UCaaaaaaaa", "v2": "UCaaaaaaaa", "v3": "v3", "v4": "UC00000000", "v5": "UC00000000", "v7": "@alone", "v9": "v9"}


def test_deal_keeps_groups_whole_and_shares_near(spark):
    rng = random.Random(4)
    videos = [(f"v{i}", f"g{min(i % 701, rng.randrange(900))}") for i in range(4000)]
    weight = [(v, rng.randint(0, 30)) for v, _ in videos]
    groups = spark.createDataFrame(videos, "video_id string, group_key string")
    for alone in (1.0, 0.02):
        rows = S.deal(groups, spark.createDataFrame(weight, "video_id string, weight bigint"), {"train": 0.8, "validation": 0.1, "test": 0.1}, alone).collect()
        by, sums, w = defaultdict(set), defaultdict(int), dict(weight)
        for r in rows:
            by[r["group_key"]].add(r["split"])
            sums[r["split"]] += w[r["video_id"]]
        assert len(rows) == len(videos) and all(len(x) == 1 for x in by.values())
        assert abs(sums["train"] / sum(sums.values()) - 0.8) < (0.06 if alone == 1 else 0.01)
    empty = S.deal(groups.limit(0), spark.createDataFrame(weight, "video_id string, weight bigint"), {"train": 0.8, "test": 0.2})
    assert empty.count() == 0

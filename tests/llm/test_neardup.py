from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from exposit.llm import neardup as N

COLUMNS = "comment_id string, text string, key string, digest int"


def texts(seed=3, roots=30, copies=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for r in range(roots):
        base = [rng.choice(vocab) for _ in range(rng.randint(18, 40))]
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                k = rng.randrange(len(words))
                rng.choice((lambda: words.pop(k), lambda: words.insert(k, rng.choice(vocab)), lambda: words.__setitem__(k, rng.choice(vocab))))()
            rng.shuffle(words) if c == 3 else None
            out.append((f"c{r}-{c}", rng.choice((" ", ", ", "\n")).join(words).upper() if c == 4 else " ".join(words)))
    return out


def brute(rows, threshold=0.75, least=20):
    bags = {k: Counter(N._WORD(t.lower())) for k, t in rows if k and t}
    bags = {k: b for k, b in bags.items() if b.total() >= least}
    return {(min(a, b), max(a, b)) for a, b in combinations(bags, 2) if (bags[a] & bags[b]).total() >= threshold * (bags[a] | bags[b]).total()}


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], COLUMNS)
    links, members = N.near_duplicates(df, "comment_id", "text", **how)
    return links, members, {tuple(r) for r in N.pairs_of(links, members).collect()}


@pytest.mark.parametrize("tree", [1, 12_000])
def test_all_pairs_as_brute_force(spark, tree):
    rows = texts()
    rows += [("x1", rows[0][1]), ("x2", rows[0][1]), ("rep", "ha " * 900), ("rep2", "ha " * 880), ("x1", rows[0][1])]
    assert found(spark, rows, tree=tree)[2] == brute(dict(rows).items())


def test_large_trees_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "SMALL", 4)
    rows = texts(seed=5, roots=1, copies=120)
    links, members, pairs = found(spark, rows)
    assert pairs == brute(rows)
    groups = {r["key"]: r["group"] for r in N.groups_of(links, members).collect()}
    assert len(groups) == members.count()


@pytest.mark.parametrize("cut", [None, 40])
def test_trees_of_many_levels_lose_no_pair(monkeypatch, cut):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "FAN", 2)
    h = N._Hashes()
    rows = texts(seed=11, roots=12, copies=12)
    sets = [N.word_set(t, h) for _, t in rows]
    sizes = np.array([len(s) for s in sets])
    points = N.points_of(np.arange(len(sets)), sizes, np.concatenate(sets))
    trees = [N.Tree(points)] if cut is None else [N.Tree(points[:cut]), N.Tree(points[cut:])]
    assert len(trees[-1].levels) > 2
    got = {(min(a, b), max(a, b)) for a, b in zip(*(x.tolist() for x in N.tree_join(trees[0], trees[1] if cut else None, 0.75)))}
    bound = lambda i, j: np.bitwise_count(points.bits[i] & points.bits[j]).sum() + min(points.beyond[i], points.beyond[j])
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if (cut is None or i < cut <= j) and len(np.intersect1d(sets[i], sets[j])) * 7 >= 3 * (sizes[i] + sizes[j])}
    assert want <= got and all(bound(i, j) * 7 >= 3 * (sizes[i] + sizes[j]) for i, j in got)
    assert len(got) < 0.2 * len(sets) ** 2


def test_bound_is_never_below_what_is_shared():
    h = N._Hashes()
    sets = [N.word_set(t, h) for _, t in texts(seed=9)] + [N.word_set("ha " * 90, h)]
    sizes = np.array([len(s) for s in sets])
    p = N.points_of(np.arange(len(sets)), sizes, np.concatenate(sets))
    for i, j in combinations(range(len(sets)), 2):
        bound = np.bitwise_count(p.bits[i] & p.bits[j]).sum() + min(p.beyond[i], p.beyond[j])
        assert bound >= len(np.intersect1d(sets[i], sets[j]))


def test_nothing_in_nothing_out(spark):
    assert found(spark, [])[2] == set()
    assert found(spark, [("a", None), (None, "w " * 30), ("b", ""), ("c", "too short")])[2] == set()


def test_a_tree_of_200_000_points_is_spread_over_tasks(spark, monkeypatch):
    # Points, as edited copies of texts of many sizes would give them, all in one tree.
    rng = np.random.default_rng(1)
    n = 200_000
    sizes = np.sort(rng.integers(20, 5000, n))
    low = np.left_shift(np.uint64(1), rng.integers(0, 64, (n, 12)).astype(np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"key": 7, "id": np.arange(n), "size": sizes | sizes << 32, "low": low, "high": low, "much": n}))
    tasks = []
    monkeypatch.setattr(N, "_block_join", lambda t: lambda batches: (tasks_of(b) for b in batches))

    def tasks_of(batch):
        from pyspark import TaskContext

        return N.pa.RecordBatch.from_arrays([N.pa.array([TaskContext.get().partitionId()] * batch.num_rows, N.pa.int64()), N.pa.array(range(batch.num_rows), N.pa.int64())], names=["a", "b"])

    tasks = N._large_trees(df, 0.75).collect()
    assert len({r["a"] for r in tasks}) >= 4
    blocks = -(-n // N.BLOCK)
    assert len(tasks) < blocks * (blocks + 1) // 2


def test_a_text_may_have_as_many_words_as_characters(spark):
    rows = [("a", "İ" * 24), ("b", "İ" * 23), ("c", "İ" * 19), ("d", "ab" * 12)]
    assert brute(rows) == {("a", "b")}
    assert found(spark, rows)[2] == {("a", "b")}


def test_bounds_of_blocks_are_fixed_before_points_are_placed(spark, monkeypatch):
    kept, cut = [], N.cut
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "cut", lambda df: kept.append(df.columns) or cut(df))
    rows = texts(seed=6, roots=1, copies=80)
    assert found(spark, rows)[2] == brute(rows)
    assert ["key", "bounds"] in kept


def test_trees_stay_whole_when_the_join_with_the_large_ones_changes_its_kind(spark, monkeypatch):
    # A sort-merge join that turns into a broadcast one while running reads its shuffle by mapper, not by key.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    monkeypatch.setattr(N, "BLOCK", 32)
    rows = texts(seed=5, roots=1, copies=120) + [(f"y{k}", t) for k, t in texts(seed=8, roots=60)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert found(spark, rows)[2] == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

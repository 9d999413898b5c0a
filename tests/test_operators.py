from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposit.functions import scalars as X
from exposit.operators import descriptive, ladder, metrics, ranks, retrieval, split, text


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_durations(spark):
    said = ["PT1H2M3S", "PT60S", "PT61S", "PT", "P1DT2H", "P0D", "", None, "PT10S ", "PT3S2M"]
    assert values(spark, said, X.duration_seconds) == [3723, 60, 61, 0, None, None, None, None, None, None]
    assert values(spark, said, X.is_short) == [False, True, False, True] + [False] * 6


def test_words_at_any_white_space(spark):
    said = ["a b", "  a b ", "a\xa0b", "a b　c", "a\x1cb\x85c", "a​b", "", None, "\n"]
    assert values(spark, said, X.word_count) == [len((x or "").split()) for x in said]


def test_caps_runs(spark):
    words = ["WOW", "WOWW", "1234", "ABCª", "STRAẞE", "日本語字", "ABCd", "A1B2", "ПРИВЕТ", "wow"]
    assert values(spark, words, X.has_caps_run) == [len(w) > 3 and w.isupper() for w in words]


def test_hashes_days_and_units(spark):
    from hashlib import sha256

    assert values(spark, ["u1", "", None], lambda c: X.author_hash(c, "s")) == [sha256(b"su1").hexdigest()[:20], None, None]
    days = values(spark, ["2026-08-13 06:00:00", "2026-08-13 08:00:00"], lambda c: X.quota_day(c.cast("timestamp")))
    assert days == ["2026-08-12", "2026-08-13"]
    assert values(spark, [0, 100, 101, None], X.estimated_units, "bigint") == [2, 2, 3, 2]
    assert values(spark, ["7", "x", "", None], X.as_int) == [7, None, None, None]


def averaged(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x])


def test_average_ranks_with_ties_and_hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.choice((0, 0, 0, 1, 5, rng.randrange(10**6))), i) for i in range(3000)]
    got = ranks.rank_percentile(spark.createDataFrame(rows, "g string, v bigint, i int"), "g", "v", "y").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])
        assert [r["y"] for r in own] == pytest.approx(averaged([r["v"] for r in own]) / max(1, len(own) - 1))
    five = ranks.rank_percentile(spark.createDataFrame([("v", x) for x in (0, 0, 0, 1, 5)], "g string, v bigint"), "g", "v", "y")
    assert sorted(r["y"] for r in five.collect()) == [0.25, 0.25, 0.25, 0.75, 1.0]


def test_timeline_position(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.7 else "b", 1_700_000_000 + rng.randrange(400), f"c{i}") for i in range(800)] + [("one", 5, "c")]
    df = spark.createDataFrame(rows, "g string, s bigint, i string").withColumn("at", F.timestamp_seconds("s"))
    got = {r["i"]: r["p"] for r in ranks.timeline_position(df, "g", "at", "i", "p").collect()}
    for g in ("a", "b", "one"):
        own = sorted((r[1], r[2]) for r in rows if r[0] == g)
        assert [got[i] for _, i in own] == pytest.approx([k / max(1, len(own) - 1) for k in range(len(own))])


def test_spearman_and_auc(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(rng.choice([0, 0, 1, 3])), float(np.round(rng.normal(), 1)), k) for g, n in (("a", 50), ("b", 20), ("c", 19)) for k in range(n)]
    rows += [("flat", 0, float(k), k) for k in range(30)] + [("same", k % 4, 1.0, k) for k in range(30)]
    df = spark.createDataFrame(rows, "v string, y int, p double, k int")
    rho = {r["v"]: r["rho"] for r in metrics.spearman(df, "v", "y", "p").collect()}
    auc = {r["v"]: r["auc"] for r in metrics.auc(df, "v", F.col("y") >= 1, "p").collect()}
    assert set(rho) == {"a", "b"} and "flat" not in auc and auc["same"] == 0.5
    for g in rho:
        y, p = (np.array([r[k] for r in rows if r[0] == g], float) for k in (1, 2))
        assert rho[g] == pytest.approx(np.corrcoef(averaged(y), averaged(p))[0, 1])
        pos, neg = p[y >= 1], p[y < 1]
        assert auc[g] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_bootstrap_weights_by_videos(spark):
    rows = [("x", f"v{i}", 1.0) for i in range(9)] + [("y", "w", 0.0), ("z", "n", None)]
    r = metrics.bootstrap_ci(spark.createDataFrame(rows, "channel string, video string, m double"), "channel", "m", 200).collect()[0]
    assert r["mean"] == 0.9 and r["lo"] == 0.0 and r["hi"] == 1.0 and 0.5 < r["p_gt_0"] < 1


def test_splits_are_nested_and_repeatable(spark):
    df = spark.createDataFrame([(f"c{i}",) for i in range(40)] * 2, "channel string")
    a, b = (sorted(map(tuple, split.nested_split(df, "channel").collect())) for _ in range(2))
    assert a == b and len(a) == 40 and {s: [x[1] for x in a].count(s) for s in ("test", "val", "fit")} == {"test": 8, "val": 5, "fit": 27}


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(47, 8))
    rows = [(i, [float(x) for x in v[i]], float(i % 5)) for i in range(40)]
    q = spark.createDataFrame([(100 + i, [float(x) for x in v[40 + i]], 0.0) for i in range(7)], "k bigint, v array<double>, l double")
    ref = spark.createDataFrame(rows + [(99, None, 1.0)], "k bigint, v array<double>, l double")
    got = {r["query"]: r["estimate"] for r in retrieval.estimates(retrieval.nearest(q, ref, "k", "v", "l", 5), 5).collect()}
    for i in range(7):
        top = np.argsort(-(v[:40] @ v[40 + i]), kind="stable")[:5]
        assert got[100 + i] == pytest.approx(np.mean(top % 5))
    with pytest.raises(ValueError):
        retrieval.nearest(q, ref, "k", "v", "l", 41)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    r = retrieval.mean_pairwise_cosine(spark.createDataFrame([(x.tolist(),) for x in unit], "v array<double>"), "v").collect()[0]
    assert r["mean_cosine"] == pytest.approx((unit @ unit.T)[np.triu_indices(47, 1)].mean(), abs=1e-6)


def test_tfidf_by_hand(spark):
    docs = {"a": "red red fish", "b": "red bird", "c": "fish bird sings", "d": "É clair"}
    df = spark.createDataFrame(list(docs.items()), "i string, t string")
    counts = text.term_counts(df, "i", F.col("t"))
    vocab = text.vocabulary(counts, 2, 10)
    assert [r["term"] for r in vocab.collect()] == ["red", "bird", "fish"]
    w = {(r["i"], r["term"]): r["weight"] for r in text.tfidf(counts, vocab, "i", 4).collect()}
    idf = np.log(5 / 3) + 1
    a = np.array([(1 + np.log(2)) * idf, idf])
    assert [w["a", "red"], w["a", "fish"]] == pytest.approx(list(a / np.linalg.norm(a)))
    assert ("b", "red") in w and ("d", "clair") not in w
    pairs = [r["term"] for r in text.term_counts(df.where("i = 'a'"), "i", F.col("t"), 2).orderBy("term").collect()]
    assert pairs == ["fish", "red", "red fish", "red red"]
    assert df.where("i = 'd'").select(text.strip_accents(F.col("t"))).collect()[0][0] == "E clair"


@pytest.mark.parametrize("wide", [False, True])
def test_ridge_is_the_closed_form(spark, wide):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 5)), rng.normal(size=200)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "a array<double>, y double").select(array_to_vector("a").alias("x"), "y")
    for alpha in (1.0, 100.0):
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(5), xc.T @ yc)
        assert ladder.ridge(df, alpha, wide).coefficients.toArray() == pytest.approx(want, abs=1e-5)


def test_share_split():
    parts = ladder.share_split(0.62, 0.63, 0.65)
    assert parts == pytest.approx({"exposure": 0.8, "length": 0.0666667, "content": 0.1333333}, abs=1e-6) and sum(parts.values()) == pytest.approx(1)


def test_scaling_a_constant_gives_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, "fit"), (3.0, 2.0, "fit"), (9.0, 2.0, "test")], "a double, b double, split string")
    assert [tuple(r) for r in ladder.scaled(df, ["a", "b"]).select("a", "b").collect()] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


def test_top_share_with_ties(spark):
    df = spark.createDataFrame([(x,) for x in [0] * 150 + [3] * 49 + [100]], "v bigint")
    r = descriptive.top_share(df, "v", 0.01).collect()[0]
    assert r["n"] == 200 and r["top_share"] == pytest.approx(103 / 247, abs=1e-6)


def test_a_wide_ridge_of_unlike_columns_is_the_closed_form(spark):
    # Terms that nearly always occur together and of very different frequency take many steps; a fit that ends early is off.
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(8)
    x = (rng.random((600, 40)) < np.geomspace(0.9, 0.01, 40)).astype(float)
    x[:, 1:20:2] = x[:, 0:20:2]
    x[rng.random(600) < 0.005, 1] = 3.0
    x[:, 0] *= 400
    y = x @ rng.normal(size=40) * 0.1 + rng.normal(size=600)
    df = spark.createDataFrame([(Vectors.sparse(40, np.flatnonzero(a).tolist(), a[a != 0].tolist()), float(b)) for a, b in zip(x, y)], ["x", "y"])
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.01, 1.0):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(40), xc.T @ yc)
        model = ladder.ridge(df, alpha, True)
        assert model.coefficients.toArray() == pytest.approx(want, abs=1e-6)
        assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-5)


def test_all_penalties_take_the_passes_of_the_slowest(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"c{i}", f"v{i % 6}", "ch", float(v @ [1, -1, 2]), int(v[0] > 0), "test" if i % 6 == 5 else "val" if i % 6 == 4 else "fit", *v.tolist()) for i, v in enumerate(rng.normal(size=(240, 3)))]
    df = spark.createDataFrame(rows, "comment_id string, video_id string, channel string, y double, like_count int, split string, a double, b double, c double")
    passes, summed = [], ladder._summed
    monkeypatch.setattr(ladder, "_summed", lambda s, files, of: passes.append(1) or summed(s, files, of))
    wide, pred = ladder.fit_tuned(df, ["a", "b", "c"], True)
    narrow, same = ladder.fit_tuned(df, ["a", "b", "c"], False)
    assert wide == narrow and len(passes) <= 12
    assert {r["comment_id"]: r["prediction"] for r in pred.collect()} == pytest.approx({r["comment_id"]: r["prediction"] for r in same.collect()}, abs=1e-6)


def test_the_heaviest_columns_are_taken_together(spark, monkeypatch):
    # Chains of terms that nearly always occur together: one by one they take many passes.
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(10)
    x = np.repeat((rng.random((500, 10)) < 0.5).astype(float), 4, 1)
    x[rng.random(x.shape) < 0.02] = 2.0
    y = x @ rng.normal(size=40) + rng.normal(size=500)
    df = spark.createDataFrame([(Vectors.sparse(40, np.flatnonzero(a).tolist(), a[a != 0].tolist()), float(b)) for a, b in zip(x, y)], ["x", "y"])
    passes, summed = [], ladder._summed
    monkeypatch.setattr(ladder, "_summed", lambda s, files, of: passes.append(1) or summed(s, files, of))
    xc, yc = x - x.mean(0), y - y.mean()
    for heavy, most in ((1024, 6), (8, 200)):
        monkeypatch.setattr(ladder, "HEAVY", heavy)
        passes.clear()
        assert ladder.ridge(df, 1.0, True).coefficients.toArray() == pytest.approx(np.linalg.solve(xc.T @ xc + np.eye(40), xc.T @ yc), abs=1e-6)
        assert len(passes) <= most

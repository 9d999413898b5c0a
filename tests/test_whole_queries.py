"""Queries without SQL that must take in every comment, against brute force on small tables."""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposit.operators import generate, ladder, metrics, split, text
from exposit.plans import corpus, queries

TABLES = "/root/testdata/sf0.001"
TEXTS = ["Café crème", "cafe creme now", "CAFÉ crème 😀", "привет мир", "Привет мир й", "привет, мир!", "привет мир снова", "cafe creme", "café crème", "мир привет мир", "plain words only", None]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(f"c{i:02}", x, "2026-01-01 00:00:00", 0, 0, "") for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "comment_id string, text string, fetched_at string, like_count bigint, reply_count bigint, updated_at string")
    df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).write.parquet(f"{d}/comments.parquet")
    return d


def terms(x):
    plain = "".join(c for c in unicodedata.normalize("NFKD", (x or "").lower()) if not unicodedata.combining(c))
    w = re.findall(r"\b\w\w+\b", plain)
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def test_vocabulary_and_weights_of_all_comments(spark, tables):
    docs = {f"c{i:02}": terms(x) for i, x in enumerate(TEXTS)}
    df = Counter(t for d in docs.values() for t in d)
    cf = sum(docs.values(), Counter())
    want = {t: (n, cf[t]) for t, n in df.items() if n >= 5}
    assert {r["term"]: (r["df"], r["cf"]) for r in queries.vocabulary_all(spark, tables).collect()} == want
    assert {"привет мир", "cafe creme"} <= set(want)
    weights = {}
    for c, d in docs.items():
        w = {t: (1 + np.log(n)) * (np.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in d.items() if t in want}
        weights |= {(c, t): x / np.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    got = {(r["comment_id"], r["term"]): r["weight"] for r in queries.tfidf_all(spark, tables).collect()}
    assert got == pytest.approx(weights, abs=2e-6)


def test_marks_of_any_script_are_stripped(spark):
    said = ["É", "が", "й", "ｆ"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(text.strip_accents(F.col("t"))).collect()] == ["E", "か", "и", "f"]


def test_the_ladder_counts_terms_without_accents(spark):
    df = spark.createDataFrame([("a", "Café", "fit"), ("b", "cafe", "fit"), ("c", "CAFÉ new", "test")], "k string, t string, split string")
    got = {r["k"]: r["tfidf"] for r in ladder.sparse_tfidf(df, "k", "t", 2, 10, "split = 'fit'").collect()}
    assert {i: v.toArray().tolist() for i, v in got.items()} == {"a": [1.0], "b": [1.0], "c": [1.0]}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_the_ladder_keeps_the_stated_vocabulary(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(df, key, column, min_df, top, fit):
        raise Seen(min_df, top)

    monkeypatch.setattr(ladder, "sparse_tfidf", seen)
    with pytest.raises(Seen) as e:
        queries.ridge_ladder(spark, TABLES)
    assert e.value.args == (5, 200_000)


def test_the_gate_reports_every_text_rung(spark, monkeypatch):
    per_video = spark.createDataFrame([("v1", "c1", 0.6), ("v2", "c2", 0.7)], "video_id string, channel string, auc double")
    monkeypatch.setattr(queries, "_ladder_input", lambda s, d, tfidf, embed: (tfidf, embed))

    def run(df, rungs, n_boot):
        assert df == (True, True)
        return [{"rung": r[0], "auc": 0.65} for r in rungs], {r[0]: per_video for r in rungs}

    monkeypatch.setattr(ladder, "run", run)
    assert [r["rung"] for r in queries.gate_report(spark, "").collect()] == ["tfidf", "embed"]


def ranked(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x])


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_both_pools_and_both_skills(spark):
    vec = {r["vec_id"]: np.asarray(r["embedding"], float) for r in queries._vectors(spark, TABLES).collect()}
    f = corpus.featured(spark, TABLES)
    f = f.join(split.channel_split(f, "channel"), "channel").withColumn("vec_id", F.pmod(F.xxhash64("comment_id"), F.lit(len(vec))))
    rows = [r for r in f.select("comment_id", "video_id", "y", "like_count", "split", "vec_id").collect() if vec.get(r["vec_id"]) is not None]
    train, test = ([r for r in rows if r["split"] == x] for x in ("train", "test"))
    ref, likes = np.stack([vec[r["vec_id"]] for r in train]), np.array([r["like_count"] for r in train], float)
    ids, names = np.array([r["vec_id"] for r in train]), np.array([r["comment_id"] for r in train])
    order = [np.lexsort((names, ids, -np.round(ref @ vec[r["vec_id"]], 12)))[:20] for r in test]
    own, y = np.array([r["like_count"] for r in test], float), np.array([r["y"] for r in test])
    est = {k: np.array([likes[o[:k]].mean() for o in order]) for k in (1, 5, 20)}
    tops = {"absolute": own >= np.quantile(own, 0.9), "within_video": y >= 0.9}
    got = {(r["pool"], r["k"]): (r["n_top"], r["top_mean"], r["all_mean"]) for r in queries.circularity_pools(spark, TABLES).collect()}
    assert set(got) == {(p, k) for p in tops for k in est}
    for p, k in got:
        assert got[p, k] == pytest.approx((tops[p].sum(), est[k][tops[p]].mean(), est[k].mean()), abs=1e-5)
    skill = {r["pool"]: (r["n"], r["rho"]) for r in queries.circularity_skill(spark, TABLES).collect()}
    e = np.round(est[5], 9)
    assert skill["pooled"] == pytest.approx((len(test), np.corrcoef(ranked(own), ranked(e))[0, 1]), abs=1e-5)
    videos = np.array([r["video_id"] for r in test])
    rhos = [np.corrcoef(ranked(y[m]), ranked(e[m]))[0, 1] for m in (videos == v for v in set(videos)) if m.sum() >= 20 and len(set(y[m])) > 1 and len(set(e[m])) > 1]
    assert skill["within_video"] == pytest.approx((len(rhos), np.mean(rhos)), abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_intervals_have_the_stated_resamples(spark, monkeypatch):
    seen = []

    def ratio_ci(a, b, key, value, n_boot):
        seen.append(n_boot)
        return spark.range(1)

    def gate(rows, per_video, base, n_boot=400):
        seen.append(n_boot)
        return [{"rung": "embed", "delta": None, "lo": None, "hi": None, "p_gt_0": None, "passes": False, "text_share_of_auc": None}]

    monkeypatch.setattr(metrics, "ratio_ci", ratio_ci)
    monkeypatch.setattr(queries, "_ladder_input", lambda *a: None)
    monkeypatch.setattr(ladder, "run", lambda *a: ([], {}))
    monkeypatch.setattr(ladder, "gate", gate)
    queries.retrieval_score_table(spark, TABLES)
    queries.gate_report(spark, TABLES)
    assert seen == [2000, 2000]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_prompts_show_twelve_examples(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(generate, "complete", lambda df: kept.append(df) or df.selectExpr("*", "'' AS text", "0 AS tokens", "0.0 AS cost_usd"))
    queries.generate_stub(spark, TABLES)
    shown = {sum(x.startswith("- ") for x in r["prompt"].split("\n")) for r in kept[0].where("condition = 'top_liked'").collect()}
    assert shown == {12}

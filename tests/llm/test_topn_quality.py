from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from exposit.llm import quality as Q
from exposit.llm import topn
from exposit.sources.tables import listing


def brute(rows, n):
    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == g and r[3] is not None), key=lambda r: (-(r[1] if r[1] is not None else -1e18), r[2] if r[2] is not None else 1e18, r[3]))
        out |= {(g, r[3], k + 1) for k, r in enumerate(own[:n])}
    return out


def test_top_n_with_hot_groups_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROW_GROUP_BYTES", 2048)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(60)}", rng.choice((0, 0, 0, 1, 5, None, rng.randrange(1000))), rng.choice((None, rng.randrange(50))), f"i{k:05}") for k in range(6000)] + [(None, 3, 1, "x"), ("g1", 3, 1, None)]
    df = spark.createDataFrame(rows, "g string, s bigint, t bigint, i string").withColumn("rank", F.lit(0)).withColumn("_x", F.lit(1))
    got = topn.top_n(df, "g", "s", "t", "i", 5, file_rows=500)
    assert {(r["g"], r["i"], r["rank"]) for r in got.collect()} == brute(rows, 5)
    assert topn.top_n(df.limit(0), "g", "s", "t", "i", 5).count() == 0


def test_row_groups_below_are_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(60_000).select(F.lit("g").alias("_g"), F.col("id").alias("_s"), F.lit(0).cast("bigint").alias("_t"), F.col("id").cast("string").alias("_i")).coalesce(1).sortWithinPartitions(F.desc("_s")).write.option("parquet.block.size", "65536").parquet(path)
    best, read, every = topn.read_top(listing(spark, path)[0], 5)
    assert sorted(best["_s"]) == [59995, 59996, 59997, 59998, 59999] and read == 1 < every


PROSE = "The host then questioned an experiment, smiled, and told the story of a gardener. It was not easy for us to see why. "
LIST = "- brisk kettle\n- mixing the dough\n- 40 g of flour\n- rusty hinge\n- old lantern\n- tiny harbor\n- calm street\n"
TABLE = "name,views,likes\nkettle,12,4\nhinge,99,1\nlantern,7,0\nharbor,55,3\nstreet,61,2\n"
JUNK = "8f 91 3c bc 1d 61 a4 f2 9d 7f bc 68 94 f6 37 14 c4 67 46 e7 f2 24 46 50 5f 25 3a f5 13 4a d4 b2 60 90 97 77 82 98"


def test_kinds(spark):
    docs = [(i, PROSE * (1 + i % 5), "en") for i in range(60)] + [(100, LIST, "en"), (101, TABLE, None), (102, JUNK, None), (103, None, "en"), (104, "", "en"), (105, " \n\t", None), (106, PROSE * 2500, "de"), (107, PROSE + "\n" + LIST[:30], "en"), (100, LIST, "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("kind", F.lit("x")).withColumn("n_words", F.lit(1))
    stats, out = Q.judge(df, "doc_id", "text", "lang")
    rows = out.collect()
    kind = {r["doc_id"]: r["kind"] for r in rows}
    assert {k: v for k, v in kind.items() if v} == {100: "list", 101: "table", 102: "junk"} and len(rows) == len(docs)
    for r in rows:
        if r["contributions"] is not None:
            assert abs(sum(r["contributions"].values()) - r["distance"]) < 1e-6 * max(1, r["distance"])
    s = {r["doc_id"]: r for r in stats.collect()}
    assert s[103]["n_words"] == 0 and s[103]["symbol_share"] is None and s[105]["word_length"] is None and s[0]["n_lines"] == 1


def test_empty_table(spark):
    stats, out = Q.judge(spark.createDataFrame([], "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    assert stats.count() == 0 and out.count() == 0


def test_the_distance_decides_and_not_the_share_of_lines(spark):
    # One and the same line shares: unusual for prose of whole lines, usual where prose often has lists.
    rng = np.random.default_rng(2)
    usual = {"word_length": 1.6, "symbol_share": 0.03, "digit_share": 0.01, "ended_share": 0.95, "common_share": 0.3, "top_word_share": 0.06, "mixed_share": 0.0, "letter_share": 0.96, "item_share": 0.02, "field_share": 0.0, "vowel_share": 0.4}
    rows = []
    for i in range(600):
        one = {k: v + rng.normal(0, 0.01) for k, v in usual.items()}
        rows.append((i, "en", *one.values()))
        rows.append((1000 + i, "de", *(one | {"item_share": rng.uniform(0, 1)}).values()))
    odd = usual | {"item_share": 0.8}
    schema = "id bigint, lang string, " + ", ".join(f"{s} double" for s in Q.STATS)
    kind = {}
    for lang in ("en", "de"):
        own = [r for r in rows if r[1] == lang]
        model = Q.fit_prose(spark.createDataFrame(own, schema))
        kind[lang] = Q.outliers(spark.createDataFrame([(1, lang, *odd.values())], schema), "id", model).collect()[0]["kind"]
    assert kind == {"en": "list", "de": None}


def test_a_language_of_few_rows_has_its_model(spark):
    docs = [(i, PROSE * (1 + i % 5), "en") for i in range(60)] + [(100 + i, "Das ist nicht so einfach, und der Gärtner hat es auch nicht gewusst. Ich bin für den Garten. ", "de") for i in range(3)]
    stats, out = Q.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    assert sorted(Q.fit_prose(stats)) == ["de", "en"] and out.where("kind is not null").count() == 0

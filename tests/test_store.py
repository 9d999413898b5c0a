from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from exposit.operators import generate, population, store
from exposit.sources import export, pages
from exposit.streaming import collect


def test_replay_changes_nothing_and_last_observation_counts(spark):
    log = spark.createDataFrame([("c1", "t1", 1, "nice"), ("c1", "t3", None, "changed"), ("c1", "t2", 9, "nice"), ("c1", "t2", 9, "nice"), ("c2", "t1", 4, "x"), (None, "t1", 1, "y")], "id string, at string, likes bigint, text string")
    want = {"c1": (None, "t3", "nice"), "c2": (4, "t1", "x")}
    for df in (log, log.union(log)):
        assert {r["id"]: (r["likes"], r["at"], r["text"]) for r in store.upsert(df, "id", ["at", "likes"], ["likes", "at"], ["text"]).collect()} == want
    new = store.insert_new(spark.createDataFrame([("c1",)], "id string"), log.where("id is not null"), "id")
    assert [r["id"] for r in new.collect()] == ["c2"]


VIDEOS = [("v_big", "c1", 900, "pending"), ("v_small", "c1", 300, "pending"), ("v_none", "c2", None, "pending"), ("v_on", "c2", 999, "in_progress"), ("v_done", "c2", 1, "done"), ("v_fail", "c2", 2, "failed")]
SCHEMA = "video_id string, channel_id string, comment_count bigint, status string"


def test_queue_and_exclusions(spark):
    v = spark.createDataFrame(VIDEOS, SCHEMA)
    assert [r["video_id"] for r in store.work_queue(v).collect()] == ["v_on", "v_none", "v_small", "v_big"]
    rest = v.where("status not in ('in_progress', 'pending')")
    assert store.next_video(rest).count() == 0 and store.next_video(rest, retry_failed=True).collect()[0]["video_id"] == "v_fail"
    reason = {r["video_id"]: r["reason"] for r in store.exclusions(v, 2, 950, 1).collect()}
    assert reason == {"v_big": "included", "v_small": "over_channel_cap", "v_none": "no_comment_count", "v_on": "too_many", "v_done": "too_few", "v_fail": "included"}
    s = store.summary(v, spark.createDataFrame([("c", "v_on")], "comment_id string, video_id string")).collect()[0]
    assert s["videos"] == "done=1,failed=1,in_progress=1,pending=3" and s["comments"] == 1
    assert store.summary(v.limit(0), spark.createDataFrame([], "comment_id string, video_id string")).collect()[0]["comments"] == 0


def test_quota(spark):
    ledger = spark.createDataFrame([("2026-08-12", 4), ("2026-08-12", 5), ("2026-08-13", None), (None, 7)], "day_pt string, units_used bigint")
    assert {r["day"]: (r["used"], r["remaining"], r["can_spend"]) for r in store.quota(ledger, 10).collect()} == {"2026-08-12": (9, 1, True), "2026-08-13": (0, 10, True)}
    assert store.quota(store.spend(ledger, "2026-08-12", 1, 10), 10).where("not can_spend").count() == 1
    for bad in (lambda: store.quota(ledger, 0), lambda: store.spend(ledger, "2026-08-12", -1, 10)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        store.spend(ledger, "2026-08-12", 2, 10)


def test_displayed_ranks(spark):
    probes = spark.createDataFrame([("v", ["c", "a", "b"], "t0"), ("v", ["a", "c"], "t1")], "video_id string, ids array<string>, fetched_at string")
    assert {r["comment_id"]: r["rank"] for r in store.relevance(probes).collect()} == {"a": 1, "c": 2, "b": 3}


def thread(cid, text="nice", original=None, at="2026-01-01T01:00:00Z", author="a1", likes=1):
    return {"snippet": {"totalReplyCount": 0, "topLevelComment": {"id": cid, "snippet": {"textDisplay": text, "textOriginal": original, "likeCount": likes, "publishedAt": at, "authorChannelId": {"value": author} if author else None}}}}


def test_parse(spark):
    page = {"items": [thread("c1"), thread("c2", "", "raw"), thread("c3", None, None), thread("c4", at=None), {}, thread("c5", author=None, likes=None)]}
    rows = pages.parse_threads(spark.createDataFrame([(json.dumps(page),), ("not json",), (None,)], "p string"), "p").collect()
    assert {r["comment_id"]: (r["text"], r["author_channel_id"], r["like_count"]) for r in rows} == {"c1": ("nice", "a1", 1), "c2": ("raw", "a1", 1), "c5": ("nice", None, 0)}


def test_errors_and_retries():
    kinds = [pages.ApiError(*e).kind for e in ((403, "quotaExceeded"), (403, "rateLimitExceeded"), (429, ""), (403, "commentsDisabled"), (404, ""), (503, ""))]
    assert kinds == ["quota", "throttle", "throttle", "terminal", "terminal", "transient"]
    waits, script = [], [pages.ApiError(503), pages.ApiError(429), {"ok": 1}]

    def get():
        x = script.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert pages.with_retry(get, sleep=waits.append, draw=lambda: 0.5) == {"ok": 1} and waits == [1.0, 8.0]
    with pytest.raises(pages.ApiError):
        pages.with_retry(lambda: (_ for _ in ()).throw(pages.ApiError(403, "quotaExceeded")), sleep=waits.append)
    assert len(waits) == 2 and pages.redacted({"key": "secret", "id": "v"}) == {"key": "***", "id": "v"}


def test_paged_source_in_batch_and_stream(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(json.dumps({"video_id": "v", "page": {"items": [thread(f"c{i}")]}}) for i in range(5)) + "\n" + json.dumps({"video_id": "w", "error": "commentsDisabled"}) + "\n")
    spark.dataSource.register(pages.PagedSource)
    batch = spark.read.format("exposit_pages").option("path", str(path)).load()
    assert batch.count() == 6 and batch.where("error is not null").count() == 1
    stream = spark.readStream.format("exposit_pages").option("path", str(path)).option("pagesPerBatch", "2").load()
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").count() == 6 and spark.table("seen").select("page_no").distinct().count() == 6


def test_stream_with_budget(spark, tmp_path):
    rows = [(f"v{i}", json.dumps({"items": [thread(f"c{i}", likes=i)]}), i) for i in range(6)]
    df = spark.createDataFrame(rows, "video_id string, page string, s bigint").select("video_id", "page", F.timestamp_seconds("s").alias("fetched_at"))
    df.write.parquet(f"{tmp_path}/pages")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/pages")
    collect.collect(read(), f"{tmp_path}/all")
    assert collect.state(f"{tmp_path}/all", spark).count() == 6
    collect.collect(read(), f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all/log").count() == 6
    collect.collect(read(), f"{tmp_path}/some", budget=4)
    assert collect.state(f"{tmp_path}/some", spark).count() == 4 and spark.read.parquet(f"{tmp_path}/some/paused").count() == 2
    assert spark.read.parquet(f"{tmp_path}/some/ledger").agg(F.sum("units_used")).collect()[0][0] == 4
    collect.collect(read(), f"{tmp_path}/some", budget=1)
    assert collect.state(f"{tmp_path}/some", spark).count() == 5 and spark.read.parquet(f"{tmp_path}/some/paused").count() == 1
    collect.collect(read(), f"{tmp_path}/some")
    assert collect.state(f"{tmp_path}/some", spark).count() == 6 and not collect._paused(spark, f"{tmp_path}/some")


def test_population(tmp_path):
    c = population.PopulationConfig.of({"name": "n", "channels": ["a", "b"], "published_after": "2025-01-01", "published_before": "2026-01-01"})
    assert population.population_hash(c, ["v1", "v2"]) == population.population_hash(c, ["v2", "v1"]) != population.population_hash(c, ["v1"])
    with pytest.raises(ValueError):
        population.PopulationConfig.of({"name": "n", "channels": [], "published_after": "", "published_before": "", "typo": 1})
    path = str(tmp_path / "m.json")
    m = population.write_manifest(path, c, [{"video_id": "v1", "channel_id": "c1", "comment_count": 300}, {"video_id": "v2", "channel_id": "c2", "comment_count": 900}], {"too_few": 3}, 50)
    assert population.read_population(path) == json.loads(json.dumps(m)) and m["estimated_units"] == 14
    tampered = json.loads(open(path).read())
    tampered["videos"].append({"video_id": "v3"})
    open(path, "w").write(json.dumps(tampered))
    with pytest.raises(ValueError):
        population.read_population(path)
    assert population.bind(None, "h") == population.bind("h", "h") == "h"
    with pytest.raises(ValueError):
        population.bind("h", "other")


def test_release(spark, tmp_path):
    import gzip
    from hashlib import sha256

    df = spark.createDataFrame([("c1", None, "é"), ("c2", 3, "x")], "id string, rank int, text string")
    n, files = export.write_jsonl_gz(df, f"file://{tmp_path}/c", single=True)
    raw = (tmp_path / "c" / files[0][0]).read_bytes()
    assert n == 2 and len(files) == 1 and sha256(raw).hexdigest() == files[0][1]
    assert '"rank":null' in gzip.decompress(raw).decode() and "é" in gzip.decompress(raw).decode()


def test_release_is_in_order_with_its_manifest(spark, tmp_path):
    import gzip

    c = spark.createDataFrame([("c2", "v2", "t1"), ("c3", "v1", "t2"), ("c1", "v1", "t1")], "comment_id string, video_id string, published_at string").repartition(3)
    v = spark.createDataFrame([("v2",), ("v1",)], "video_id string")
    m = export.write_release(c, v, f"file://{tmp_path}/r")
    rows = [json.loads(x) for f in m["comments"]["files"] for x in gzip.decompress((tmp_path / "r" / "comments" / f["name"]).read_bytes()).decode().splitlines()]
    assert [r["comment_id"] for r in rows] == ["c1", "c3", "c2"] and m["comments"]["rows"] == 3 and m["videos"]["rows"] == 2
    assert json.loads(spark.read.text(f"file://{tmp_path}/r/manifest", wholetext=True).collect()[0][0]) == m


def test_generation_stub(spark):
    ex = spark.createDataFrame([("c1", "line\none"), ("c2", "two")], "comment_id string, text string")
    v = spark.createDataFrame([("v1", "A title"), ("v2", None)], "video_id string, title string")
    rows = generate.complete(generate.prompts(ex, v, 2, 2, 3)).collect()
    assert len(rows) == 12 and all('"' not in r["text"] and r["cost_usd"] == 0.0 for r in rows)
    assert all(("got the most likes" in r["prompt"]) == (r["condition"] == "top_liked") for r in rows) and any("a video" in r["prompt"] for r in rows)

"""What becomes of each video: pages, probe, resuming, pausing, refusals and errors, as the collection's behaviours are stated."""

from __future__ import annotations

import pytest

from exposit.sources.pages import ApiError
from exposit.streaming import crawl


class Scripted:
    def __init__(self, *script):
        self.script, self.calls, self.stored = list(script), [], []

    def get(self, video, token):
        self.calls.append(token)
        x = self.script.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    def store(self, video, page):
        new = [i for i in page["items"] if i not in self.stored]
        self.stored += new
        return len(new)


def page(*ids, token=None):
    return {"items": list(ids)} | ({"nextPageToken": token} if token else {})


def collected(script, budget=10, token=None, probe=None, used=0):
    ledger = crawl.Ledger(budget, {"d": used})
    return list(crawl.collect_video({"video_id": "v1", "page_token": token}, script.get, ledger, "d", script.store, probe)), ledger


def test_two_pages_and_a_probe():
    s = Scripted(page("c1", "c2", token="t2"), page("c3"))
    events, ledger = collected(s, probe=lambda v: ["c3", "c1"])
    assert [(e["event"], e["page_token"], e["new_comments"]) for e in events[:2]] == [("page", "t2", 2), ("page", None, 1)]
    assert events[-1]["status"] == "done" and events[-1]["ranks"] == ["c3", "c1"] and s.calls == [None, "t2"] and ledger.used["d"] == 3


def test_resumes_at_the_stored_token():
    s = Scripted(page("c9"))
    events, _ = collected(s, token="tok-mid")
    assert s.calls == ["tok-mid"] and events[-1]["status"] == "done"


def test_pauses_with_its_token_when_the_budget_is_spent():
    events, ledger = collected(Scripted(page("c1", token="t2"), page("c2")), budget=1)
    assert (events[-1]["status"], events[-1]["reason"], events[-1]["page_token"]) == ("in_progress", "paused", "t2") and ledger.remaining("d") == 0


def test_a_refused_video_is_skipped_and_costs_nothing():
    events, ledger = collected(Scripted(ApiError(403, "commentsDisabled")))
    assert (events[-1]["status"], events[-1]["reason"]) == ("skipped", "commentsDisabled") and ledger.used["d"] == 0


def test_a_quota_error_exhausts_the_day():
    events, ledger = collected(Scripted(page("c1", token="t2"), ApiError(403, "quotaExceeded")))
    assert (events[-1]["status"], events[-1]["reason"], events[-1]["page_token"]) == ("in_progress", "quota", "t2")
    assert ledger.remaining("d") == 0 and ledger.remaining("next") == 10


def test_a_passing_error_fails_and_a_failed_probe_does_not():
    assert collected(Scripted(ApiError(503)))[0][-1]["status"] == "failed"

    def probe(video):
        raise ApiError(503)

    events, ledger = collected(Scripted(page("c1")), probe=probe)
    assert events[-1]["status"] == "done" and events[-1]["ranks"] == [] and ledger.used["d"] == 1
    assert collected(Scripted(page("c1")), budget=1, probe=probe)[0][-1]["status"] == "done"


def test_ledger_keeps_before_it_counts_and_refuses_bad_values():
    kept = []
    ledger = crawl.Ledger(50, {"d": 48}, lambda day, units: kept.append((day, units)))
    ledger.spend("d")
    ledger.exhaust("d")
    assert kept == [("d", 1), ("d", 1)] and ledger.remaining("d") == 0
    for bad in (lambda: crawl.Ledger(0), lambda: ledger.spend("d", -1)):
        with pytest.raises(ValueError):
            bad()


def test_states_are_an_aggregate_over_the_log(spark):
    s = Scripted(page("c1", "c2", token="t2"), page("c2", "c3"), ApiError(403, "commentsDisabled"), page("c5", token="t9"), page("c6", token="t10"))
    queue = [{"video_id": v} for v in ("a", "b", "c", "d")]
    events = crawl.run(queue, s.get, crawl.Ledger(4), "d", s.store)
    rows = [(e["seq"], e["video_id"], e["event"], e["page_token"], e["new_comments"], e["status"], e["reason"], "2026-01-01") for e in events]
    for log in (rows, rows + rows[:3]):
        got = {r["video_id"]: (r["status"], r["page_token"], r["pages_fetched"], r["comments_stored"], r["completed_at"]) for r in crawl.video_states(spark.createDataFrame(log, crawl.EVENTS)).collect()}
        assert got == {"a": ("done", None, 2, 3, "2026-01-01"), "b": ("skipped", None, 0, 0, "2026-01-01"), "c": ("in_progress", "t10", 2, 2, None)}
    assert crawl.video_states(spark.createDataFrame([], crawl.EVENTS)).count() == 0

"""Collecting videos page by page: what becomes of each, with resumable tokens and a daily budget.

A crawl is a log of events, appended to and never changed: a page taken with the token of the next one, or the end of a video with its status. A video's state is an
aggregate over its events, so a replayed event changes nothing. The log is one row per page and holds no text: it is what a driver appends between
pages, while the pages' comments go through ``collect``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposit.sources.pages import ApiError

EVENTS = "seq bigint, video_id string, event string, page_token string, new_comments bigint, status string, reason string, at string"


@dataclass
class Ledger:
    """Units by Pacific day. ``used`` may be loaded from stored rows; every change is given to ``keep`` before it counts."""

    budget: int
    used: dict[str, int] = field(default_factory=dict)
    keep: Callable[[str, int], None] = lambda day, units: None

    def __post_init__(self) -> None:
        if self.budget <= 0:
            raise ValueError("the budget must be positive")

    def remaining(self, day: str) -> int:
        return max(0, self.budget - self.used.get(day, 0))

    def spend(self, day: str, units: int = 1) -> None:
        if units < 0:
            raise ValueError("units can't be negative")
        self.keep(day, units)
        self.used[day] = self.used.get(day, 0) + units

    def exhaust(self, day: str) -> None:
        """Nothing is left of a day whose quota the service says is spent."""
        self.spend(day, self.remaining(day))


def collect_video(video: dict, get: Callable[[str, str | None], dict], ledger: Ledger, day: str, store: Callable[[str, dict], int], probe: Callable[[str], list[str]] | None = None) -> Iterator[dict]:
    """The events of a video's pages, from its stored token on; the last one tells what became of it.

    Status 'done' after the last page; 'skipped' with the reason if the service refuses the video for good, which costs nothing; 'failed' after an error that may
    pass; 'in_progress' with reason 'quota' or 'paused' if the day's units are spent, by the service's word or by the ledger's. ``get`` is (video, token) to a page,
    ``store`` takes a page and tells how many comments were new. The probe for displayed ranks runs after the last page if a unit is left; its errors change nothing.
    """
    vid, token = video["video_id"], video.get("page_token")
    base = {"video_id": vid, "event": "page", "page_token": None, "new_comments": 0, "status": "in_progress", "reason": None}
    end = lambda status, reason=None, **more: base | {"event": "end", "status": status, "reason": reason} | more
    while True:
        if not ledger.remaining(day):
            yield end("in_progress", "paused", page_token=token)
            return
        try:
            page = get(vid, token)
        except ApiError as e:
            if e.kind == "quota":
                ledger.exhaust(day)
                yield end("in_progress", "quota", page_token=token)
            else:
                yield end("skipped" if e.kind == "terminal" else "failed", e.reason or str(e.status))
            return
        ledger.spend(day)
        token = page.get("nextPageToken")
        yield base | {"page_token": token, "new_comments": store(vid, page)}
        if not token:
            break
    ranks: list[str] = []
    if probe and ledger.remaining(day):
        try:
            ranks = probe(vid)
            ledger.spend(day)
        except ApiError:
            pass
    yield end("done", ranks=ranks)


def run(queue: list[dict], get: Callable, ledger: Ledger, day: str, store: Callable, probe: Callable | None = None) -> list[dict]:
    """Videos of the queue in order, until the day's units are spent: all events, numbered."""
    out: list[dict] = []
    for video in queue:
        out += collect_video(video, get, ledger, day, store, probe)
        if out[-1]["status"] == "in_progress":
            break
    return [{"seq": k, **e} for k, e in enumerate(out)]


def video_states(events: DataFrame) -> DataFrame:
    """(video_id, status, reason, page_token, pages_fetched, comments_stored, completed_at) from events, each counted once by its number.

    The last event decides status and token; a video that ended in any way but a pause has none.
    """
    once = events.where("video_id is not null").groupBy("video_id", "seq").agg(F.max(F.struct("event", "status", "reason", "page_token", "new_comments", "at")).alias("e")).select("video_id", "seq", "e.*")
    last = F.max(F.struct("seq", "status", "reason", "page_token", "at")).alias("l")
    s = once.groupBy("video_id").agg(last, F.count_if(F.col("event") == "page").alias("pages_fetched"), F.sum("new_comments").alias("comments_stored"))
    closed = F.col("l.status") != "in_progress"
    return s.select("video_id", "l.status", "l.reason", F.when(~closed, F.col("l.page_token")).alias("page_token"), "pages_fetched", "comments_stored", F.when(closed, F.col("l.at")).alias("completed_at"))

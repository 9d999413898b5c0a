"""Raw pages of a comment API: parsing, error classes, and a paged source for batch and streaming reads."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAGE = "items array<struct<snippet: struct<totalReplyCount: int, topLevelComment: struct<id: string, snippet: struct<textDisplay: string, textOriginal: string, likeCount: int, publishedAt: string, updatedAt: string, authorChannelId: struct<value: string>>>>>>, nextPageToken string"
#: Error reasons of the API by what they mean.
QUOTA = ("quotaExceeded", "dailyLimitExceeded")
THROTTLE = ("rateLimitExceeded", "userRateLimitExceeded")
TERMINAL = ("commentsDisabled", "videoNotFound", "forbidden", "channelNotFound", "playlistNotFound")


def parse_threads(pages: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Comments of raw JSON pages. The displayed text goes before the original unless it is empty; without text or date a thread is dropped. ``keep`` are columns of the page to keep."""
    item = F.explode(F.from_json(F.col(column), PAGE)["items"]).alias("t")
    c = F.col("t.snippet.topLevelComment")
    s = c["snippet"]
    flat = pages.select(*(keep or []), item).select(
        *(keep or []),
        c["id"].alias("comment_id"),
        s["authorChannelId"]["value"].alias("author_channel_id"),
        F.coalesce(F.nullif(s["textDisplay"], F.lit("")), F.nullif(s["textOriginal"], F.lit(""))).alias("text"),
        F.coalesce(s["likeCount"], F.lit(0)).cast("bigint").alias("like_count"),
        F.coalesce(F.col("t.snippet.totalReplyCount"), F.lit(0)).cast("bigint").alias("reply_count"),
        F.try_to_timestamp(s["publishedAt"]).alias("published_at"),
        s["updatedAt"].alias("updated_at"),
    )
    return flat.where("text is not null and published_at is not null and comment_id is not null")


class ApiError(Exception):
    def __init__(self, status: int, reason: str = ""):
        super().__init__(f"{status} {reason}")
        self.status, self.reason = status, reason

    @property
    def kind(self) -> str:
        """'quota', 'throttle', 'terminal' or 'transient'."""
        if self.reason in QUOTA:
            return "quota"
        if self.reason in THROTTLE or self.status == 429:
            return "throttle"
        return "terminal" if self.reason in TERMINAL or 400 <= self.status < 500 else "transient"


def redacted(params: dict) -> dict:
    """Request parameters without the key, for messages."""
    return {k: "***" if k == "key" else v for k, v in params.items()}


def with_retry(get: Callable[[], dict], retries: int = 4, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> dict:
    """``get()`` with exponential back-off and jitter; throttling waits four times as long, quota and terminal errors aren't retried."""
    for attempt in range(retries + 1):
        try:
            return get()
        except ApiError as e:
            if e.kind in ("quota", "terminal") or attempt == retries:
                raise
            sleep((4 if e.kind == "throttle" else 1) * 2**attempt * (0.5 + draw()))
    raise AssertionError


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _pages(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


class PagedSource(DataSource):
    """``spark.read.format("exposit_pages")``: (video_id, page_no, page) from files of scripted pages, one JSON object per line.

    It stands for an HTTP source where there is no network. A line is {"video_id", "page"} or {"video_id", "error", "status"}. Batch: a partition per file. Stream: the offset is the
    number of pages taken, ``pagesPerBatch`` a trigger; a page is taken again only if its batch wasn't committed.
    """

    @classmethod
    def name(cls) -> str:
        return "exposit_pages"

    def schema(self) -> str:
        return "video_id string, page_no int, page string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(self.options)


def _row(k: int, x: dict) -> tuple:
    return x.get("video_id"), k, json.dumps(x["page"]) if "page" in x else None, x.get("error")


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from (_row(k, x) for k, x in enumerate(_pages(partition.path)))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("pagesPerBatch", "2"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        every = _pages(self.path)
        end = min(len(every), start["page"] + self.each)
        return iter([_row(k, every[k]) for k in range(start["page"], end)]), {"page": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([_row(k, x) for k, x in enumerate(_pages(self.path)) if start["page"] <= k < end["page"]])

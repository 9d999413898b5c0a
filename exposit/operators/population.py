"""Which videos are collected: configuration, the identity hash of a population, and its manifest."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timezone
from hashlib import sha256
from pathlib import Path


@dataclass(frozen=True)
class PopulationConfig:
    name: str
    channels: tuple[str, ...]
    published_after: str
    published_before: str
    min_comments: int = 200
    max_comments: int = 5000
    max_videos_per_channel: int = 20
    max_upload_pages: int = 10

    @staticmethod
    def of(values: dict) -> PopulationConfig:
        unknown = sorted(set(values) - {f.name for f in fields(PopulationConfig)})
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(unknown)}")
        return PopulationConfig(**values | {"channels": tuple(values["channels"])})

    @staticmethod
    def read(path: str) -> PopulationConfig:
        return PopulationConfig.of(json.loads(Path(path).read_text(encoding="utf-8")))


def population_hash(config: PopulationConfig, video_ids: list[str]) -> str:
    """SHA-256 of the configuration and the sorted ids as compact JSON with sorted keys; the order of the ids doesn't matter."""
    body = {"config": asdict(config), "video_ids": sorted(video_ids)}
    return sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_manifest(path: str, config: PopulationConfig, videos: list[dict], excluded: dict[str, int], units_spent: int) -> dict:
    """The manifest of a frozen population, written as indented JSON with sorted keys."""
    from math import ceil

    ids = [v["video_id"] for v in videos]
    units = sum(max(1, ceil((v.get("comment_count") or 0) / 100)) + 1 for v in videos)
    manifest = {
        "created_at": datetime.now(timezone.utc).isoformat(), "config": asdict(config), "population_hash": population_hash(config, ids), "n_videos": len(ids), "n_channels": len({v.get("channel_id") for v in videos}),
        "estimated_units": units, "estimated_comments": sum(v.get("comment_count") or 0 for v in videos), "excluded": excluded, "freeze_units_spent": units_spent, "videos": videos,
    }
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return manifest


def read_population(path: str) -> dict:
    """A manifest whose hash agrees with its configuration and videos; raises if it was tampered with."""
    m = json.loads(Path(path).read_text(encoding="utf-8"))
    if population_hash(PopulationConfig.of(m["config"]), [v["video_id"] for v in m["videos"]]) != m["population_hash"]:
        raise ValueError("the population's hash doesn't agree with its content")
    return m


def bind(bound: str | None, population: str) -> str:
    """The hash a store is bound to; the same one again changes nothing, another is refused."""
    if bound not in (None, population):
        raise ValueError("the store holds another population")
    return population

"""The release: comments and videos as gzipped JSON lines, with checksums in a manifest."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame

from exposit.sources.tables import listing


def _checksums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each file, read in parts of a megabyte."""
    import pyarrow.fs

    for pdf in batches:
        sums = []
        for path in pdf["path"]:
            fs, at = pyarrow.fs.FileSystem.from_uri(path)
            digest = sha256()
            with fs.open_input_file(at) as f:
                while part := f.read(1 << 20):
                    digest.update(part)
            sums.append(digest.hexdigest())
        yield pd.DataFrame({"path": pdf["path"], "sha256": sums})


def write_jsonl_gz(df: DataFrame, path: str, single: bool = False) -> tuple[int, list[tuple[str, str]]]:
    """Rows written, and (file, sha256) of each. Nulls are written as null. Files stay apart unless ``single`` asks for one, which takes one task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    spark = df.sparkSession
    files = spark.createDataFrame([(f,) for f in listing(spark, path)], "path string")
    # One job over all files; a task reads its files in small parts.
    sums = files.repartition(max(1, files.count())).mapInPandas(_checksums, "path string, sha256 string").collect()
    return spark.read.schema(df.schema).json(path).count(), sorted((r["path"].rsplit("/", 1)[1], r["sha256"]) for r in sums)


def write_release(comments: DataFrame, videos: DataFrame, folder: str) -> dict:
    """Comments in order of video and time, videos in order of id, and a manifest of both, which is written beside them and returned."""
    manifest: dict = {}
    order = [c for c in ("video_id", "published_at", "comment_id") if c in comments.columns]
    for name, df in (("comments", comments.orderBy(*order)), ("videos", videos.orderBy("video_id"))):
        n, files = write_jsonl_gz(df, f"{folder}/{name}")
        manifest[name] = {"rows": n, "fields": df.columns, "files": [{"name": f, "sha256": s} for f, s in files]}
    manifest["digest"] = sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    text = json.dumps(manifest, indent=2, sort_keys=True)
    comments.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest

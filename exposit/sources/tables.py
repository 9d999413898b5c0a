"""Reading the corpus tables, and the shared folder in which intermediate tables live."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKED: set[tuple[str, str]] = set()
#: Spark removes an execution's shuffle files at its end under this setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus by name. Zone-free timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    casts = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(casts) if casts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application that all executors share; it is removed when the driver ends.

    It is the context's checkpoint folder, whether ``spark.checkpoint.dir`` or the user's own call has set it. Where neither has, a folder of this
    machine is made for a local master, as in tests; any other master is refused, since executors couldn't read it.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="exposit-"))
        at = sc.getCheckpointDir()
    if (sc.applicationId, at) not in _MARKED:
        _MARKED.add((sc.applicationId, at))
        fs, path = _file_system(spark, at)
        fs.deleteOnExit(path)
    return at.rstrip("/")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder; survives the loss of executors. Its shuffle files go."""
    shared_dir(df.sparkSession)
    if not eager:
        return df.checkpoint(False)
    with _cleaning(df.sparkSession):
        return df.select("*").checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a written table."""
    return f"{shared_dir(spark)}/exposit-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there; its shuffle files go. ``drop`` removes it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Remove tables that ``written`` or ``scratch`` made in the shared folder, once no plan reads them any more."""
    for t in tables:
        for path in {t} if isinstance(t, str) else {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            fs, at = _file_system(spark, path)
            if not at.getName().startswith("exposit-"):
                raise ValueError(f"{path} is none of the intermediate tables")
            fs.delete(at, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    """The data files of a written table, as URIs."""
    fs, at = _file_system(spark, path)
    return sorted(x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))

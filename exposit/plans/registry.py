"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from inspect import getmembers, isfunction

from pyspark.sql import DataFrame, SparkSession

from exposit.plans import queries
from exposit.plans.sql import SQL as _SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for n, f in getmembers(queries, isfunction) if not n.startswith("_") and f.__module__ == queries.__name__}
SQL = {k: v for k, v in _SQL.items() if k in QUERIES}

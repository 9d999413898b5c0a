"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    rows = [r.asDict() for r in entry.queries()[name](spark, TABLES).collect()]
    sql = con.sql(entry.oracle_sql()[name])
    want = [dict(zip(sql.columns, x)) for x in sql.fetchall()]
    assert not rows or sorted(rows[0]) == sorted(sql.columns)
    both = [sorted(repr([plain(r[c]) for c in sorted(r)]) for r in x) for x in (rows, want)]
    assert both[0] == both[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["decile", "n", "mean_log1p"] and df.count() > 0


def test_core_does_not_import_the_training_data_package():
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "exposit", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "exposit.llm" not in open(path, encoding="utf-8").read(), path

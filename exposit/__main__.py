"""python -m exposit [--master URL] QUERY TABLES [OUT]: runs a query over a folder of tables; prints it, or writes Parquet to OUT."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from exposit.plans.registry import QUERIES


def main(args: list[str]) -> int:
    master = None
    if args[:1] == ["--master"]:
        master, args = args[1], args[2:]
    if len(args) < 2 or args[0] not in QUERIES:
        print(__doc__, "\nQueries:", ", ".join(sorted(QUERIES)))
        return 2
    builder = SparkSession.builder.appName(f"exposit {args[0]}").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(master) if master else builder).getOrCreate()
    result = QUERIES[args[0]](spark, args[1])
    result.write.mode("errorifexists").parquet(args[2]) if len(args) > 2 else result.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

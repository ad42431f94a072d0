"""``python -m bidloom``: runs queries or a check item over a data directory and writes what they give.

    python -m bidloom list
    python -m bidloom run DIR OUT QUERY...
    python -m bidloom item DIR OUT CODE [COMPANY...]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from bidloom.plans import candidates, catalog, evidence, items, rollups  # noqa: F401
from bidloom.session import local_session, remove_tables
from bidloom.sources import store


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bidloom", description="Evidence analytics over a data directory.")
    what = parser.add_subparsers(dest="what", required=True)
    what.add_parser("list", help="names of the queries and check items")
    run = what.add_parser("run", help="write queries as Parquet")
    item = what.add_parser("item", help="write a check item's verdicts as JSON")
    for p in (run, item):
        p.add_argument("directory")
        p.add_argument("out")
    run.add_argument("queries", nargs="+")
    item.add_argument("code")
    item.add_argument("companies", nargs="*", type=int)
    a = parser.parse_args(arguments)
    queries = catalog.QUERIES
    if a.what == "list":
        print(*queries, *items.ITEMS, sep="\n")
        return 0
    if a.what == "run" and (unknown := [q for q in a.queries if q not in queries]):
        print(f"unknown: {', '.join(unknown)}", file=sys.stderr)
        return 2
    own = spark is None
    spark = spark or local_session()
    try:
        if a.what == "run":
            for q in a.queries:
                store.write_table(queries[q](spark, a.directory), f"{a.out}/{q}")
        else:
            store.write_report(items.analyze(spark, a.directory, a.code, a.companies or None), f"{a.out}/{a.code}")
    finally:
        remove_tables(spark)
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

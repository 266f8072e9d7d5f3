"""python -m ledgerloom list | run QUERY TABLES OUTPUT: run a catalogue query over a folder of tables into Parquet."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of all queries")
    run = verbs.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("output")
    options = parser.parse_args(args)

    from ledgerloom.plans import catalogue, problems

    queries = {**catalogue.QUERIES, **problems.QUERIES}
    if options.verb == "list":
        print("\n".join(sorted(queries)))
        return 0
    if options.query not in queries:
        print(f"no such query: {options.query}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from ledgerloom.session import ship

    spark = SparkSession.builder.appName(f"ledgerloom {options.query}").getOrCreate()
    ship(spark)
    queries[options.query](spark, options.tables).write.mode("errorifexists").parquet(options.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())

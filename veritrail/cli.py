"""Command line for spark-submit: list the registered queries, or run one over a folder of tables."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veritrail", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--explain", action="store_true")
    told = parser.parse_args(args)
    from veritrail.plans.registry import QUERIES

    if told.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if told.query not in QUERIES:
        print(f"no query {told.query}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    frame = QUERIES[told.query](SparkSession.builder.getOrCreate(), told.folder)
    if told.explain:
        frame.explain("formatted")
    elif told.out:
        frame.write.parquet(told.out)
    else:
        frame.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())

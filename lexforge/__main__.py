"""Command line: run one of the engine's queries over a folder of Parquet tables.

    python -m lexforge --list
    python -m lexforge run_report /path/to/tables --rows 20 --out /path/to/result
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexforge.plans import catalog, chains, flagship
from lexforge.sources import io


def main(argv: list[str] | None = None) -> int:
    known = {**flagship.QUERIES, **catalog.QUERIES, **chains.QUERIES}
    ap = argparse.ArgumentParser(prog="lexforge", description=__doc__.split("\n")[0])
    ap.add_argument("query", nargs="?", choices=sorted(known), metavar="query")
    ap.add_argument("tables", nargs="?", help="folder that holds <table>.parquet")
    ap.add_argument("--rows", type=int, default=20, help="rows to print")
    ap.add_argument("--out", help="write the whole result there as JSON lines")
    ap.add_argument("--list", action="store_true", help="names of the queries")
    args = ap.parse_args(argv)
    if args.list or not (args.query and args.tables):
        print("\n".join(sorted(known)))
        return 0 if args.list else 2
    df = known[args.query](SparkSession.builder.getOrCreate(), args.tables)
    if args.out:
        io.write_json(df, args.out)
    else:
        io.print_summary(df.limit(args.rows), args.query)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

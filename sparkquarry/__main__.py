"""Run a registered query: ``python -m sparkquarry fts_search --sf-dir DIR [--out DIR]``; without a name, list them.

``python -m sparkquarry --run file_fts,graph_path,dense,rule_router --split dev --ks 1,3,5 --sf-dir DIR`` evaluates methods on the questions of
a split, ``--check-leaks DIR`` looks for private keys in rows written before.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sparkquarry.operators.dataset import assert_public, private_rows
from sparkquarry.operators.stages import parse_ks
from sparkquarry.plans import stage_queries  # noqa: F401  adds its queries
from sparkquarry.plans.registry import QUERIES
from sparkquarry.plans.stage_queries import evaluated
from sparkquarry.sources.corpus import write_jsonl


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkquarry", description=__doc__)
    parser.add_argument("query", nargs="?", choices=sorted(QUERIES))
    parser.add_argument("--sf-dir")
    parser.add_argument("--out", help="folder for JSON lines; refuses to overwrite; without it rows are shown")
    parser.add_argument("--run", help="methods to evaluate, separated by commas")
    parser.add_argument("--split", default="all", choices=["all", "dev", "test"])
    parser.add_argument("--ks", default="1,3,5", help="cutoffs, separated by commas")
    parser.add_argument("--check-leaks", help="folder of JSON lines; fails if a row holds a private key")
    args = parser.parse_args(argv)
    if args.check_leaks or args.run and args.sf_dir:
        spark = SparkSession.builder.appName("sparkquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.check_leaks:
            rows = spark.read.json(args.check_leaks)
            assert_public(rows)
            if private_rows(rows).take(1):
                raise ValueError("private keys in maps of public rows")
            print(f"{rows.count()} rows without private keys")
            return
        rows = evaluated(spark, args.sf_dir, args.run.split(","), args.split, parse_ks(args.ks))
        write_jsonl(rows, args.out) if args.out else rows.show(50, truncate=80)
        return
    if not args.query or not args.sf_dir:
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("sparkquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = QUERIES[args.query](spark, args.sf_dir)
    write_jsonl(rows, args.out) if args.out else rows.show(50, truncate=80)


if __name__ == "__main__":
    main()

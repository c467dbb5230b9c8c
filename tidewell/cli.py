"""Command line: ``python -m tidewell.cli barcode|count ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.pipelines import run_count, run_illumina, run_nanopore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("barcode", help="assign cell barcodes and UMIs to reads")
    b.add_argument("--r1", required=True)
    b.add_argument("--r2")
    b.add_argument("--whitelist", required=True)
    b.add_argument("-o", "--out", required=True)
    b.add_argument("--nanopore", action="store_true")
    b.add_argument("--one-file", action="store_true")
    c = sub.add_parser("count", help="count transcripts in each cell")
    c.add_argument("--b1", required=True)
    c.add_argument("-o", "--out", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "barcode" and not args.nanopore and not args.r2:
        print("read pairs need --r2", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("tidewell").getOrCreate()
    if args.command == "count":
        counts = run_count(spark, args.b1, args.out)
    elif args.nanopore:
        counts = run_nanopore(spark, args.r1, args.whitelist, args.out, args.one_file)
    else:
        counts = run_illumina(spark, args.r1, args.r2, args.whitelist, args.out, args.one_file)
    print(" ".join(f"{k}={v}" for k, v in counts.items()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

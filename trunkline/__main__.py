"""Command line: ``python -m trunkline convert | restore | scan | window | search | filter``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.functions.text import compression_ratio, display_text, format_duration, format_size
from trunkline.operators.query import LogQuery, filter_exact_level, filter_query, search_display
from trunkline.sources.plaintext import convert
from trunkline.sources.trunklog import register


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trunkline")
    do = top.add_subparsers(dest="command", required=True)
    convert = do.add_parser("convert", help="plain text to one .tog file, or to a folder with a file for each range")
    convert.add_argument("input")
    convert.add_argument("output")
    convert.add_argument("compression", nargs="?", default="gzip")
    convert.add_argument("trunk_kb", nargs="?", type=int, default=512)
    restore = do.add_parser("restore", help="trunk files to plain text")
    restore.add_argument("input")
    restore.add_argument("output")
    for name in ("scan", "window", "search", "filter"):
        p = do.add_parser(name)
        p.add_argument("input")
        p.add_argument("--rows", type=int, default=100, help="lines to print")
        if name == "scan":
            p.add_argument("--start", type=int)
            p.add_argument("--end", type=int)
            p.add_argument("--level")
            p.add_argument("--keyword")
        if name == "window":
            p.add_argument("start", type=int)
            p.add_argument("count", type=int)
        if name == "search":
            p.add_argument("keyword")
        if name == "filter":
            p.add_argument("level")
    return top


def chosen(records: DataFrame, args: argparse.Namespace) -> DataFrame:
    if args.command == "scan":
        return filter_query(records, LogQuery(args.start, args.end, args.level and args.level.upper(), args.keyword))
    if args.command == "window":
        return records.where((F.col("record_index") >= args.start) & (F.col("record_index") < args.start + args.count))
    return search_display(records, args.keyword) if args.command == "search" else filter_exact_level(records, args.level.upper())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("trunkline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    register(spark)
    if args.command == "convert":
        began = time.monotonic()
        done = convert(spark, args.input, args.output, args.compression, args.trunk_kb)
        took = spark.range(1).select(
            format_size(F.lit(done["source_bytes"])).alias("source"), format_size(F.lit(done["output_bytes"])).alias("output"), compression_ratio(F.lit(done["source_bytes"]), F.lit(done["output_bytes"])).alias("ratio"),
            format_duration(F.lit(int((time.monotonic() - began) * 1e6))).alias("took"),
        ).first()
        print(f"{done['records']} records, {done['trunks']} trunks, {done['workers']} workers; {took.source} to {took.output} ({took.ratio}) in {took.took}")
        return 0
    records = spark.read.format("trunklog").load(args.input)
    shown = display_text(F.col("timestamp_millis"), F.col("level"), F.col("message")).alias("value")
    if args.command == "restore":
        records.repartitionByRange("file", "record_index").sortWithinPartitions("file", "record_index").select(shown).write.mode("overwrite").text(args.output)
        return 0
    for row in chosen(records, args).orderBy("file", "record_index").limit(args.rows).select(shown).collect():
        print(row.value)
    return 0


if __name__ == "__main__":
    sys.exit(main())

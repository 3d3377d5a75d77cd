"""python -m driftframe.cli info|schema|convert|repair-tail|frames ..."""

from __future__ import annotations

import argparse
import os
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from driftframe import errors
from driftframe.operators import frames as fr
from driftframe.operators.logs import Log, open_log
from driftframe.sources import siglog, sinks, wire


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("driftframe")
    p.add_argument("--codebook", default="")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "schema", "convert", "frames"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("--tail", choices=("strict", "lenient"), default="lenient")
        if name == "info":
            c.add_argument("--json", action="store_true")
            c.add_argument("--semantic-stats", action="store_true")
        elif name == "convert":
            c.add_argument("output")
            c.add_argument("--reorder-window-us", type=int, default=5_000_000)
            c.add_argument("--max-buffered-rows", type=int, default=100_000)
            c.add_argument("--compression", choices=sorted(sinks.CODECS), default="zstd")
            c.add_argument("--signals", nargs="*")
            c.add_argument("--rows-per-batch", type=int, help="write one file of row groups of so many rows, not a folder")
        elif name == "frames":
            c.add_argument("--arbitration-id", required=True)
            c.add_argument("--record-class", type=int)
            c.add_argument("--limit", type=int, default=32)
    r = sub.add_parser("repair-tail")
    r.add_argument("input")
    r.add_argument("output")
    return p


def info(spark: SparkSession, log: Log, args: argparse.Namespace) -> dict:
    path = args.input
    out = {"path": path, "size": os.path.getsize(path) if os.path.isfile(path) else None, "header": [h.asDict() for h in log.header.collect()], "report": log.report()}
    read = siglog.scan if os.path.exists(path) else siglog.read_logs
    out["tail"] = [t.asDict() for t in read(spark, path, "tail", args.tail, args.codebook).collect()]
    if args.semantic_stats:
        out["semantic_stats"] = fr.semantic_stats(log.updates(), "timestamp_us", "raw_id").first().asDict()
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.command == "repair-tail":
        found = sinks.write_repaired(args.input, args.output)
        return f"{found.frames} frames, {'repaired' if found.changed else 'unchanged'}"
    log = open_log(spark, args.input, args.tail, args.codebook)
    if args.command == "info":
        found = info(spark, log, args)
        return sinks.report_json(found) if args.json else sinks.report_text(found)
    if args.command == "schema":
        return sinks.report_json({k: v for k, v in log.report().items() if k in ("signals", "devices")})
    if args.command == "frames":
        rows = fr.payload_variants(log.frames, wire.parse_id(args.arbitration_id), args.record_class, args.limit).collect()
        return "\n".join(f"{r['record_class']} {bytes(r['payload']).hex()} {r['count']} {r['first_timestamp_us']}" for r in rows)
    log.check_order(args.reorder_window_us, args.max_buffered_rows)
    table = log.wide(args.signals, with_path=log.header.count() > 1)
    if args.rows_per_batch is not None:
        return f"{sinks.write_file(table, args.output, args.rows_per_batch, args.compression)} rows, {len(table.columns)} columns"
    sinks.write_table(table, args.output, args.compression)
    return f"{spark.read.parquet(args.output).count()} rows, {len(table.columns)} columns"


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
        spark = SparkSession.builder.appName("driftframe").config("spark.sql.caseSensitive", "true").getOrCreate()
        print(run(spark, args))
        return 0
    except (errors.TelemetryError, PySparkException, Py4JJavaError) as e:
        if not isinstance(found := errors.typed(e), errors.TelemetryError):
            raise
        print(f"error: {type(found).__name__}: {found}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

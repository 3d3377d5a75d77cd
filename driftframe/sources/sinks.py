"""Parquet and JSON output."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from driftframe import errors
from driftframe.operators import tables as tb
from driftframe.sources import wire

CODECS = {"uncompressed": "uncompressed", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "lz4-raw": "lz4_raw", "brotli": None}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, as spark.checkpoint.dir names it; only a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise errors.InvalidArgument("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or '/tmp/driftframe-shared').rstrip('/')}/driftframe/{name}-{uuid.uuid4().hex}"


def _codec(compression: str) -> str:
    if CODECS.get(compression) is None:
        raise errors.InvalidArgument(f"codec {compression} is not available; use one of {', '.join(k for k, v in CODECS.items() if v)}")
    return CODECS[compression]


def write_table(table: DataFrame, path: str, compression: str = "zstd", files: int | None = None, partition_by: list[str] = ()) -> None:
    """A table as a folder of Parquet files; an empty one keeps its schema. files=1 makes one file of a table small enough for one task.

    The folder is written beside path and takes its place when it is whole: a failed run leaves what was there.
    """
    spark, made = table.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    writer = (table.coalesce(files) if files else table).write.option("compression", _codec(compression))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (made, path))
    fs = new.getFileSystem(conf)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(made)
        fs.delete(target, True)
        if not fs.rename(new, target):
            raise errors.InvalidArgument(f"cannot write {path}")
    finally:
        fs.delete(new, True)


def write_file(table: DataFrame, path: str, rows: int, compression: str = "zstd") -> int:
    """A table as one local Parquet file of row groups of just rows rows, put in place when it is whole; the number of rows."""
    schema, codec = tb.to_arrow_schema(table.schema), {"uncompressed": "none", "lz4_raw": "lz4"}.get(_codec(compression), _codec(compression))
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with pq.ParquetWriter(made, schema, compression=codec) as writer:
            n = tb.batches(table, rows, lambda batch: writer.write_table(batch, row_group_size=rows))
        os.replace(made, path)
    finally:
        if os.path.exists(made):
            os.unlink(made)
    return n


def report_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=lambda x: x.hex() if isinstance(x, (bytes, bytearray)) else str(x))


def report_text(found: dict) -> str:
    """info's report as text: one line for each header field, counter, device and unsupported variant."""
    report, lines = found["report"], [f"path: {found['path']}"]
    lines += [f"size: {found['size']} bytes"] if found["size"] is not None else []
    for h in found["header"]:
        lines += [f"source: {h['source']}", f"compliancy: {h['compliancy']}", f"start Unix seconds: {h['start_time_unix_seconds']}"]
    lines += [f"physical frames: {report['raw_frames']}", f"custom frames: {report['custom_frames']}", f"timestamp range: {report['min_timestamp']} to {report['max_timestamp']} us"]
    lines += [f"out-of-order frames: {report['out_of_order_frames']} (by at most {report['max_out_of_order_us']} us)", f"signals: {len(report['signals'])}"]
    if stats := found.get("semantic_stats"):
        lines += [f"updates: {stats['updates']}", f"rows: {stats['rows']}", f"signals with updates: {stats['signals']}"]
    lines += [f"device {d['device_id']}: {d['transport']}, firmware {d['firmware']}, {'supported' if d['catalog_supported'] else 'not supported'}" for d in report["devices"]]
    lines.append(f"unsupported variants: {len(report['unsupported'])}")
    lines += [f"  id 0x{u['arbitration_id']:08x}, class {u['record_class']}, {u['payload_len']} bytes: {u['count']}, first at {u['first_decoded_offset']}" for u in report["unsupported"]]
    lines += [f"cut at {t['record_offset']}: {t['available']} of {t['needed']} bytes, bit {t['bit']}" for t in found.get("tail", [])]
    return "\n".join(lines)


def write_repaired(source: str, target: str) -> wire.Repair:
    """The repaired log as a new file; an existing target, or the source itself, is an error."""
    if os.path.realpath(source) == os.path.realpath(target):
        raise errors.InvalidArgument("input and output are the same file")
    if os.path.exists(target):
        raise errors.InvalidArgument(f"{target} exists")
    found = wire.repair_tail(Path(source).read_bytes())
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(os.path.abspath(target)), delete=False) as f:
        f.write(found.data)
        f.flush()
        os.fsync(f.fileno())
    os.link(f.name, target)
    os.unlink(f.name)
    return found

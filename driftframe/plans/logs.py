"""Queries on logs made here of the suppliers: their bytes are decoded as any others'."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.operators.logs import Log
from driftframe.sources import siglog, wire

#: A log holds the suppliers of so many keys.
KEYS = 50


def record(header: int, timestamp: int, delta: bytes) -> bytes:
    code = wire.DLC_LENGTHS.index(len(delta))
    return struct.pack("<I", header) + timestamp.to_bytes(5, "little") + bytes([code << 4]) + delta


def sample_log(events: list[tuple[int, float]], book: wire.Codebook | None = None) -> bytes:
    """A signal x in V that takes the values at the times of events."""
    name, units, data = 0xE1101001, 0xE2101001, 0xE0108001
    out, last = record(name, 0, b"x") + record(units, 0, b"V"), bytes(8)
    for t, v in events:
        now = struct.pack("<d", v)
        out, last = out + record(data, t, bytes((a - b) & 0xFF for a, b in zip(now, last))), now
    return wire.make_header() + (book or wire.codebook()).encode(out)


def logs_of_suppliers(spark: SparkSession, sf_dir: str, keys: int | None = None) -> DataFrame:
    """(path, content): all suppliers, as one log for each range of so many keys."""
    words = siglog.code_words()
    event = F.struct((F.col("s_suppkey").cast("long") * 1000).alias("t"), F.col("s_acctbal").cast("double").alias("v"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.expr(f"s_suppkey div {keys or KEYS}").alias("part"))
    rows = rows.agg(F.sort_array(F.collect_list(event)).alias("events"))  # at most so many of a part

    def run(batches):
        book = wire.Codebook(words)
        for b in batches:
            content = [sample_log([(e["t"], e["v"]) for e in events], book) for events in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], ["path", "content"])

    return rows.select(F.concat(F.lit("suppliers-"), F.col("part").cast("string")).alias("path"), "events").mapInArrow(run, "path string, content binary")


def log_of_suppliers(spark: SparkSession, sf_dir: str) -> Log:
    files = logs_of_suppliers(spark, sf_dir)
    return Log(siglog.decode(files), siglog.decode(files, "header"))


def log_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All physical records of all logs."""
    return siglog.decode(logs_of_suppliers(spark, sf_dir)).select("path", "decoded_offset", "header", "record_class", "timestamp_us", F.lower(F.hex("payload")).alias("payload"))


def log_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table of all logs."""
    return log_of_suppliers(spark, sf_dir).wide(with_path=True)


def log_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow table of the custom signals of all logs."""
    return log_of_suppliers(spark, sf_dir).narrow(with_path=True)["custom"]


def log_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of each log."""
    return log_of_suppliers(spark, sf_dir).signals()


def log_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of records that nothing decodes, of each log whose records of data are said to be of class 5."""
    files = siglog.decode(logs_of_suppliers(spark, sf_dir))
    found = Log(files.withColumn("record_class", F.when(F.col("header") == 0xE0108001, 5).otherwise(F.col("record_class")))).unsupported()
    return found.select("path", "arbitration_id", "record_class", "payload_len", "count", "first_decoded_offset", F.lower(F.hex("first_payload")).alias("first_payload"))


def queries() -> dict:
    return {"log_frames": log_frames, "log_wide": log_wide, "log_narrow": log_narrow, "log_signals": log_signals, "log_unsupported": log_unsupported}


#: Payloads are the eight bytes of a double, lowest first; a log's first 22 bytes define x.
_L = f"""l AS (SELECT 'suppliers-' || (s_suppkey // {KEYS}) AS path, s_suppkey * 1000 + 1 AS ts, s_acctbal AS x,
  22 + 18 * (row_number() OVER (PARTITION BY s_suppkey // {KEYS} ORDER BY s_suppkey) - 1) AS o, lpad(hex(CAST(s_acctbal::DOUBLE::BIT AS BLOB)), 16, '0') AS h FROM supplier
), p AS (SELECT *, lower(list_reduce(list_transform([1, 3, 5, 7, 9, 11, 13, 15], lambda i: substr(h, i, 2)), lambda a, b: b || a)) AS payload FROM l)"""


def oracle_sql() -> dict[str, str]:
    return {
        "log_frames": f"""WITH {_L} SELECT path, o AS decoded_offset, {0xE0108001} AS header, 7 AS record_class, ts AS timestamp_us, payload FROM p
  UNION ALL SELECT DISTINCT path, 0, {0xE1101001}, 7, 1, '78' FROM p UNION ALL SELECT DISTINCT path, 11, {0xE2101001}, 7, 1, '56' FROM p""",
        "log_wide": f"WITH {_L} SELECT path, ts AS timestamp, x FROM l",
        "log_narrow": f"WITH {_L} SELECT path, ts AS timestamp, o AS source_sequence, x FROM l",
        "log_signals": f"""WITH {_L} SELECT DISTINCT path, 130816::BIGINT AS raw_id, 'x' AS name, 'float64' AS signal_type, 'double' AS original_type, 'V' AS units, '{{"units": "V"}}' AS metadata,
  'custom' AS source, 'full' AS support, NULL::VARCHAR AS device, 0::BIGINT AS definition_decoded_offset, 'Simulation' AS bus FROM l""",
        "log_unsupported": f"""WITH {_L} SELECT path, {0xE0108001 & 0x1FFFFFFF}::BIGINT AS arbitration_id, 5 AS record_class, 8 AS payload_len, count(*) AS count, min(o) AS first_decoded_offset, arg_min(payload, o) AS first_payload
  FROM p GROUP BY path""",
    }

"""Logs as DataFrames: a Python data source for paths, and a decoder for binary columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from driftframe import errors
from driftframe.sources import wire
from driftframe.sources.session import copied, small_batches

FRAMES = (
    "path string, decoded_offset long, compressed_byte_offset long, compressed_bit int, header long, arbitration_id long, record_class int, "
    "encoded_timestamp_us long, timestamp_us long, dlc int, dlc_flags int, payload_delta binary, payload binary"
)
HEADERS = "path string, source string, reserved binary, compliancy int, format_flags int, start_time_unix_seconds long, size long"
TAILS = "path string, record_offset long, available int, needed int, missing_end_marker boolean, bit long"
VIEWS = {"frames": FRAMES, "header": HEADERS, "tail": TAILS}
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
SCHEMAS = {view: pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in text.split(", ")]) for view, text in VIEWS.items()}
#: Rows of an Arrow batch that leaves the decoder; whole logs that go to Python at once, and about how many bytes of them.
ROWS, FILES, FILE_BYTES = 20_000, 64, 64 << 20


def rows_of(path: str, raw: bytes, view: str, tail: str, book: wire.Codebook) -> Iterator[tuple]:
    if view == "header":
        h = wire.require_supported(wire.parse_header(raw))
        yield (path, *h, len(raw))
        return
    reader = wire.Reader(raw, tail, book)
    for f in reader.frames():
        if view == "frames":
            yield (path, *f)
    if view == "tail" and reader.tail:
        yield (path, *reader.tail)


def batches_of(rows: Iterator[tuple], view: str) -> Iterator[pa.RecordBatch]:
    """rows as Arrow batches of at most ROWS rows."""
    while held := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), SCHEMAS[view].types)], schema=SCHEMAS[view])


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.view, self.tail = options.get("view", "frames"), options.get("tail", "strict")
        if self.view not in VIEWS or self.tail not in ("strict", "lenient"):
            raise errors.InvalidArgument(f"view {self.view}, tail {self.tail}")
        self.book, self.path, self.wanted = options.get("codebook", ""), options.get("path", ""), {}

    def pushFilters(self, filters):
        """Equality on the fields of a record's header is applied while decoding, before rows are made."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("arbitration_id",), ("record_class",)) and self.view == "frames":
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        import glob
        import os

        found = sorted(p for p in (glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path)) if os.path.isfile(p))
        if not found:
            raise errors.InvalidArgument(f"no log at {self.path}")
        return [File(p) for p in found]

    def read(self, partition):
        import mmap

        book = wire.codebook(self.book)
        at = {"arbitration_id": 5, "record_class": 6}
        with open(partition.path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.seek(0, 2) else b""
            rows = rows_of(partition.path, raw, self.view, self.tail, book)
            yield from batches_of((r for r in rows if all(r[at[k]] == v for k, v in self.wanted.items())), self.view)


class LogSource(DataSource):
    """spark.read.format("siglog").option("view", "frames|header|tail").option("tail", "strict|lenient").load(path).

    For paths that every executor can open. Object stores go through read_logs(), which reads with Spark.
    """

    @classmethod
    def name(cls):
        return "siglog"

    def schema(self):
        return VIEWS[self.options.get("view", "frames")]

    def reader(self, schema):
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format siglog known; filters reach it where the session has spark.sql.python.filterPushdown.enabled."""
    spark.dataSource.register(LogSource)


def scan(spark: SparkSession, path: str, view: str = "frames", tail: str = "strict", codebook: str = "") -> DataFrame:
    """The view of the logs at a path that every executor can open: memory-mapped, of any size, filters pushed down."""
    register(spark)
    found = spark.read.format("siglog").option("view", view).option("tail", tail).option("codebook", codebook).load(path)
    return copied(found, spark__sql__python__filterPushdown__enabled="true")


def code_words(codebook: str = "") -> str:
    """The codebook as text that tasks can take along: executors have no codebook file."""
    return " ".join(f"{s:02x}:{b}" if s < 256 else f"EOS:{b}" for s, b in wire.codebook(codebook).words.items())


def decode(files: DataFrame, view: str = "frames", tail: str = "strict", codebook: str = "") -> DataFrame:
    """The view of logs given as rows (path, content), one task's rows a log at a time."""
    words = code_words(codebook)

    def run(batches):
        book = wire.Codebook(words)
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from batches_of(rows_of(path, raw, view, tail, book), view)

    return small_batches(files.select(F.col("path").cast("string"), F.col("content").cast("binary")), FILES, FILE_BYTES).mapInArrow(run, VIEWS[view])


def read_logs(spark: SparkSession, path: str, view: str = "frames", tail: str = "strict", codebook: str = "") -> DataFrame:
    """The view of all logs of up to 2 GB each at a path that Spark can read, local or remote; scan() has no such limit."""
    return decode(spark.read.format("binaryFile").load(path), view, tail, codebook)


def from_bytes(spark: SparkSession, raw: bytes, view: str = "frames", tail: str = "strict", codebook: str = "") -> DataFrame:
    return decode(spark.createDataFrame([("memory", bytearray(raw))], "path string, content binary"), view, tail, codebook)

"""What the corpus operators share: the shared folder, saved tables, words, packed rows, components."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftframe.sources.session import small_batches

#: Texts go to Python in batches of at most so many rows and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: A task that gathers packed records holds about so many bytes of them.
TASK_BYTES = 64 << 20
#: The paths saved() wrote since each result() that is still at work.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a local session may do without."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return "/tmp/driftframe-shared"  # driver and executors are one process
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/driftframe/{name}-{uuid.uuid4().hex}"
    if made := _MADE.get():
        made[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, name: str = "table", schema: StructType | None = None) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and outlives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, saved; tables that make() saved on its way are deleted then."""
    token = _MADE.set((*_MADE.get(), made := []))
    try:
        df = make()
        path = f"{shared_dir(spark)}/driftframe/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    finally:
        _MADE.reset(token)
        for old in made:
            delete(spark, old)
    if outer := _MADE.get():
        outer[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """df in a copy of its session in which Python gets at most BATCH_ROWS rows or about BATCH_BYTES bytes at once."""
    return small_batches(df, BATCH_ROWS, BATCH_BYTES)


def small(df: DataFrame) -> DataFrame:
    """The same for rows that each hold many packed records."""
    return small_batches(df, BATCH_ROWS, BATCH_BYTES // 2)


def trimmed(run: Callable) -> Callable:
    """run, a function of batches for mapInArrow, that gives memory back at its end: Python workers live on between tasks."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def partitions(spark: SparkSession, nbytes: float = 0) -> int:
    """To how many tasks packed records of nbytes in all are dealt: the session's number, or more for more bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nbytes / TASK_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], most: int = 1024) -> DataFrame:
    """rows.join(table, keys), for a table of one row for each key with n, how many of rows have it; without n.

    Keys of more than a most-th of all rows, of which there are fewer than most, are looked up by broadcast, so that no
    task gets all rows of such a key; others are joined by a shuffle. Rows of null keys, and of keys that the table lacks, go.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot, rest = table.where(F.col("n") * most > total), table.where(F.col("n") * most <= total)
    often = rows.join(F.broadcast(hot), keys)
    return rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys).unionByName(often).drop("n")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose bits all depend on all bits of x (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def dealt(targets: np.ndarray, records: np.ndarray) -> pa.RecordBatch | None:
    """records packed into one row (target, blob) for each target."""
    if not len(records):
        return None
    order = np.argsort(targets, kind="stable")
    targets, records = targets[order], records[order]
    cuts = np.flatnonzero(np.diff(targets)) + 1
    starts = np.concatenate([[0], cuts])
    blobs = [x.tobytes() for x in np.split(records, cuts)]
    return pa.RecordBatch.from_arrays([pa.array(targets[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["target", "blob"])


def gathered(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of one partition; partitions are hash-dealt, so each holds its share of the whole."""
    parts = [np.frombuffer(x, dtype) for b in batches for x in b.column("blob").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links a-b that join what was apart: at most one fewer than there are nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), both long: component is the smallest node reachable.

    Alternating large-star and small-star steps, each an aggregation and a join on
    the node, so a node with very many links is only a skewed join side. Every round is
    written to the shared folder, and the table of the round before is deleted. Joins are never broadcast: links grow with the
    data. Self-links and repeats are harmless; no edges give no rows.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = table_path(spark, "edges")
        df.write.parquet(path)
        out = spark.read.schema("u long, v long").parquet(path)
        return out, path, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now, path, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while before[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        old = path
        now, path, after = written(small.where("u <> v").distinct())
        delete(spark, old)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

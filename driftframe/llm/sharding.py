"""Sharding along a Hilbert curve.

Language, source and length are quantised to the same few bits each: values in order, so cut that steps hold about equally many
rows. The index of a row's cell on a Hilbert
curve orders the rows, so that a run of the order is compact in all three, and files cut from it can be skipped on
conditions on any of them. Runs are cut at even counts of rows. Ranks come from counts of ever
finer parts of the order; no task sorts more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.llm.shared import read, saved

SHARDS = 24
BITS = 4
#: Parts of a cell: by text, so that equal texts stand together, then by doc_id for the largest groups of them.
TEXT_PARTS, ID_PARTS = 4096, 256


def _curve(rows: DataFrame, axes: list[str], bits: int) -> DataFrame:
    """rows with cell, the index on the Hilbert curve of the point axes, coordinates of so many bits each.

    From the highest bit down, each axis either inverts the lower bits of the first or swaps them with
    its own; then comes a Gray code, and the bits are interleaved. A column for each step keeps expressions small.
    """
    names = [f"__x{i}" for i in range(len(axes))]
    rows = rows.withColumns({n: F.col(a).cast("int") for n, a in zip(names, axes)})
    for level in reversed(range(1, bits)):
        q, p = 1 << level, (1 << level) - 1
        for n in names:
            high = F.col(n).bitwiseAND(F.lit(q)) != 0
            swap = F.col(names[0]).bitwiseXOR(F.col(n)).bitwiseAND(F.lit(p))
            step = {names[0]: F.when(high, F.col(names[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(names[0]).bitwiseXOR(swap))}
            rows = rows.withColumns(step | ({n: F.when(high, F.col(n)).otherwise(F.col(n).bitwiseXOR(swap))} if n != names[0] else {}))
    for a, b in zip(names, names[1:]):
        rows = rows.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    last, t = F.col(names[-1]), F.lit(0)
    for level in reversed(range(1, bits)):
        t = F.when(last.bitwiseAND(F.lit(1 << level)) != 0, t.bitwiseXOR(F.lit((1 << level) - 1))).otherwise(t)
    rows = rows.withColumn("__t", t)
    cell = F.lit(0)
    for level in reversed(range(bits)):
        for n in names:
            cell = F.shiftleft(cell, 1).bitwiseOR(F.shiftright(F.col(n).bitwiseXOR(F.col("__t")), level).bitwiseAND(F.lit(1)))
    return rows.withColumn("cell", cell).drop(*names, "__t")


def _steps(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(column, step) of each distinct value, step from 0 to 2**bits - 1 in order of the values (nulls first), by the share of
    rows before the value's middle one.

    Sums run over ranges of values first, then within a range: no task has all values.
    """
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    counts = saved(counts.repartitionByRange(column).withColumn("range", F.spark_partition_id()), "values")
    before = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy("range").agg(F.sum("n").alias("n"))  # one row for each task
    total = sums.agg(F.sum("n")).first()[0] or 0
    ranges = sums.select("range", before("range").alias("at"))
    middle = F.col("at") + before(F.col(column).asc_nulls_first(), "range") + (F.col("n") - 1) / 2
    found = counts.join(F.broadcast(ranges), "range").withColumn("step", F.floor(middle * (1 << bits) / max(total, 1)).cast("int"))
    return saved(found.select(column, "step"), "steps")


def sharded(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot) and the columns keep for each row of docs (doc_id, text, lang, source, ...).

    Counts of rows of any two shards are at most one apart; slot counts from 0 within a shard. size is the text's
    UTF-8 bytes (null: 0) plus 8. A null language or source is the lowest value of its dimension, a null text has length 0. Within a
    cell equal texts stand together, except in groups so large that parts of them are ranked apart; those of different
    language or source stand in different cells. Rows that repeat take different
    slots, which of them which is arbitrary. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.char_length(text).alias("__length"),
        F.xxhash64(text).alias("th"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(ID_PARTS)).cast("int").alias("id_part"),
        F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source"), *(F.col(c).alias(f"__kept_{c}") for c in keep),
    )
    rows = saved(rows, "measured")
    for i, column in enumerate(("__lang", "__source", "__length")):
        steps = _steps(rows, column).select(F.col(column).alias("value"), F.col("step").alias(f"x{i}"))
        rows = rows.join(steps, F.col(column).eqNullSafe(F.col("value"))).drop("value")
    rows = _curve(rows, ["x0", "x1", "x2"], BITS).drop("x0", "x1", "x2")
    rows = saved(rows.withColumn("text_part", F.pmod(F.shiftrightunsigned("th", 40), F.lit(TEXT_PARTS)).cast("int")), "keyed")
    parts = rows.groupBy("cell", "text_part", "id_part").agg(F.count("*").alias("n"))

    def before(n: str, order: str, *by: str) -> Column:
        return F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # each of these windows holds a bounded number of rows: cells, text parts of a cell, id parts of a text part
    texts = parts.groupBy("cell", "text_part").agg(F.sum("n").alias("m"))
    cells = texts.groupBy("cell").agg(F.sum("m").alias("l")).withColumn("cell_at", before("l", "cell")).select("cell", "cell_at")
    texts = texts.withColumn("text_at", before("m", "text_part", "cell")).select("cell", "text_part", "text_at")
    parts = parts.withColumn("part_at", before("n", "id_part", "cell", "text_part")).join(texts, ["cell", "text_part"]).join(cells, "cell")
    parts = parts.select("cell", "text_part", "id_part", (F.col("cell_at") + F.col("text_at") + F.col("part_at")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("cell", "text_part", "id_part").orderBy("th", "doc_id")) - 1
    rows = rows.join(parts, ["cell", "text_part", "id_part"]).withColumn("rank", (F.col("at") + rank).cast("long"))
    # the first few shards take one row more
    each, more = divmod(rows.count(), shards)
    full = more * (each + 1)
    shard = F.when(F.col("rank") < full, F.floor(F.col("rank") / (each + 1))).otherwise(more + F.floor((F.col("rank") - full) / max(each, 1)))
    slot = F.when(F.col("rank") < full, F.col("rank") % (each + 1)).otherwise((F.col("rank") - full) % max(each, 1))
    return rows.select("doc_id", "size", "text_crc32", "cell", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), *(F.col(f"__kept_{c}").alias(c) for c in keep))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 1 << 20) -> None:
    """Writes docs, all columns, to path: a folder shard=N for each shard, of files that hold one run of its slots each.

    A file has rows_per_file rows at most and is one task's work, whatever the size of the shard. Files' own statistics then
    tell which of them a condition on language, source or length can skip.
    """
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns)))).withColumns({n: F.col(f"c{columns.index(n)}") for n in ("doc_id", "text", "lang", "source")})
    found = sharded(renamed, shards, tuple(f"c{i}" for i in range(len(columns))))
    run = F.floor(F.col("slot") / rows_per_file)
    found = found.withColumn("run", run).repartition("shard", "run").sortWithinPartitions("shard", "run", "slot")
    # a task that got several runs begins a new file for each shard, and after so many rows
    found = found.select("shard", *(F.col(f"c{i}").alias(n) for i, n in enumerate(columns)))
    found.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def skipped(spark: SparkSession, path: str, column: str, low, high) -> tuple[int, int]:
    """How many files of a folder of write_shards hold no value of column from low to high, as their least and largest value tell, and of how many."""
    c = F.col(column)
    ends = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min(c).alias("least"), F.max(c).alias("most"))
    row = ends.agg(F.count_if(F.coalesce((F.col("most") < F.lit(low)) | (F.col("least") > F.lit(high)), F.lit(True))), F.count("*")).first()
    return row[0], row[1]


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    found = sharded(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")

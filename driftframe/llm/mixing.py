"""Mixing sources to target weights.

Each source's documents stand in a permuted order, cut into blocks. Its target gives whole
passes over the source, then whole blocks of one more pass, then documents of one last
block. A splitting tree deals every source's quota of blocks out to the output shards: at
each node the blocks that go left are a hypergeometric draw from those of the node, source by
source, so that shards get disjoint permuted blocks; rows are then shuffled within a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.llm.shared import partitions, read, saved

WEIGHTS, MOST_PASSES = (5.0, 2.0, 1.0), 3
#: Blocks of a source; a block is the unit dealt to shards.
BLOCKS = 4096
SHARDS = 24
#: One number for each source and shard is held on the driver.
SOURCES = 100_000
SEED = 42


def n_words(text: Column | str) -> Column:
    """How many words, divided by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Sources in order of code point, null last, take the weights in turn and share the sum of all
    sizes; a target stops at most times its source's size, the excess going to the others
    by weight until none is above. That level has a closed form: with sources in order of
    most * size / weight, those before the first whose ratio is above the level are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full, spent = F.coalesce(F.sum(most * F.col("source_size")).over(up), F.lit(0)), F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) - full) / (F.sum("weight").over(every) - spent))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    ranked = ranked.withColumn("at", level)
    return ranked.select("source", "source_size", "weight", F.when(F.col("ratio") <= F.col("at"), (most * F.col("source_size")).cast("double")).otherwise(F.col("at") * F.col("weight")).alias("target"))


def dealt_blocks(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks each shard gets: sources by shards.

    Multivariate-hypergeometric splitting: a node of m shards with the given blocks sends a
    uniformly drawn half of places, in proportion to its shards, to the left.
    """
    out = np.zeros((len(quotas), shards), np.int64)

    def split(left: int, right: int, own: np.ndarray) -> None:
        if right - left == 1:
            out[:, left] = own
            return
        middle = (left + right) // 2
        total = int(own.sum())
        places, rest, taken = total * (middle - left) // (right - left), total, np.zeros_like(own)
        for i, n in enumerate(own.tolist()):
            rest -= n
            taken[i] = rng.hypergeometric(n, rest, places) if n and places and n + rest else 0
            places -= int(taken[i])
        split(left, middle, taken)
        split(middle, right, own - taken)

    split(0, shards, quotas.astype(np.int64))
    return out


def measured(docs: DataFrame, keep: list[str], seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """The columns keep of docs with __source, __size (words), __key (place in the permuted order) and __block."""
    text = F.col("text").cast("string")
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.crc32(F.coalesce(text, F.lit(""))))
    rows = docs.select(*keep, F.col("source").cast("string").alias("__source"), n_words(text).alias("__size"), key.alias("__key"))
    return rows.withColumn("__block", F.pmod(F.shiftright("__key", 20), F.lit(blocks)).cast("int"))


def plan(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """For each block of a source of measured rows: source_size, target, copies (whole passes over the block),
    left (words still to take of it in its last pass; null if that takes all or none) and shards, one for each pass.

    The driver holds one number for each source and shard, of at most SOURCES sources.
    """
    spark = rows.sparkSession
    by_block = saved(rows.groupBy("__source", "__block").agg(F.sum("__size").alias("block_size")), "blocks")
    sizes = targets(by_block.groupBy(F.col("__source").alias("source")).agg(F.sum("block_size").alias("source_size")))
    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # no more rows than BLOCKS
    found = by_block.select(F.col("__source").alias("of"), F.col("__block").alias("block"), "block_size").join(sizes, F.expr("source <=> of")).drop("of")
    found = found.withColumn("before", F.coalesce(F.sum("block_size").over(w), F.lit(0)))
    found = found.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    found = found.withColumn("left", F.col("target") - F.col("passes") * F.col("source_size") - F.col("before"))
    more = F.col("passes") < MOST_PASSES
    whole, part = more & (F.col("left") >= F.col("block_size")), more & (F.col("left") > 0) & (F.col("left") < F.col("block_size"))
    found = found.select("source", "block", "source_size", "target", (F.col("passes") + whole.cast("int")).alias("copies"), F.when(part, F.col("left")).alias("left"))
    found = saved(found, "plan")
    used = F.col("copies") + F.col("left").isNotNull().cast("int")
    units = found.where(used > 0).select("source", "block", F.explode(F.sequence(F.lit(1), used)).alias("pass"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block", "pass"), "block", "pass")
    units = units.withColumn("unit", F.row_number().over(order))
    quotas = units.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(SOURCES + 1).collect()
    if len(quotas) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    dealt = dealt_blocks(np.array([q["n"] for q in quotas], np.int64), shards, np.random.default_rng(seed)).cumsum(axis=1)
    cuts = spark.createDataFrame([(q["source"], [int(x) for x in c]) for q, c in zip(quotas, dealt)], "of string, cuts array<long>")
    units = units.join(cuts, F.expr("source <=> of")).select(F.col("source").alias("of"), F.col("block").alias("of_block"), "pass", F.expr("size(filter(cuts, x -> x < unit))").alias("shard"))
    units = units.groupBy("of", "of_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    return saved(found.join(units, F.expr("source <=> of and block = of_block"), "left").select("source", "block", "source_size", "target", "copies", "left", "shards"), "plan")


def mixed(rows: DataFrame, by: DataFrame) -> DataFrame:
    """measured rows with the columns of their plan, copies now being the row's own: 0 to MOST_PASSES.

    copies * __size summed over a source comes within half a document of its target. Null and
    empty texts have size 0 and go along with their place in the order. Of rows equal in doc_id and
    text, which ones the last pass takes is arbitrary, but not their number. A null source is a source.
    """
    found = rows.join(by, F.expr("source <=> __source and block = __block")).drop("block")
    part = found.where("left is not null")  # one block of each source
    w = Window.partitionBy("__source", "__block").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__size").over(w), F.lit(0))
    part = part.withColumn("copies", F.col("copies") + (before + F.col("__size") / 2 <= F.col("left")).cast("int"))
    return found.where("left is null").unionByName(part)


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: rows of docs, all columns, each as often as the mix takes it, shard after shard, shuffled within each.

    A document that the targets leave out goes; one taken twice or thrice repeats.
    """
    columns = docs.columns
    renamed = docs.toDF(*(f"__c{i}" for i in range(len(columns)))).withColumns({n: F.col(f"__c{columns.index(n)}") for n in ("doc_id", "text", "source")})
    rows = measured(renamed, [f"__c{i}" for i in range(len(columns))], seed)
    taken = mixed(rows, plan(rows, shards, seed)).where("copies > 0")
    taken = taken.withColumn("pass", F.explode(F.expr("sequence(1, copies)"))).withColumn("shard", F.expr("shards[pass - 1]"))
    # a shard is written by several tasks, more for more partitions; which of them gets a row is drawn as the order is
    pieces = max(1, -(-partitions(docs.sparkSession) // shards))
    taken = taken.withColumn("order", F.xxhash64(F.lit(seed + 1), "__key", "pass")).withColumn("piece", F.pmod("order", F.lit(pieces)))
    taken = taken.repartition(shards * pieces, "shard", "piece").sortWithinPartitions("shard", "piece", "order")
    return taken.select(*(F.col(f"__c{i}").alias(n) for i, n in enumerate(columns)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, its source's size and target and the words the mix takes of it."""
    rows = saved(measured(read(spark, sf_dir, "documents"), ["doc_id"]), "sizes")
    found = mixed(rows, plan(rows))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).alias("taken"), "shards")

"""Operators on physical records and on the order of their timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.errors import InvalidArgument, ReorderBufferLimit


def first_and_count(rows: DataFrame, keys: list[str], first: dict[str, str], order: str) -> DataFrame:
    """Of each key the number of rows, and of its first row in order the columns first, under new names."""
    agg = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.min_by(F.struct(*(F.col(c).alias(n) for c, n in first.items())), order).alias("x"))
    return agg.select(*keys, "count", "x.*")


def unsupported_rollup(frames: DataFrame, by: list[str] = ()) -> DataFrame:
    """frames that nothing decodes, rolled up by arbitration id, class and payload length (and by, a file), in key order."""
    keys = [*by, "arbitration_id", "record_class", "payload_len"]
    keyed = frames.withColumn("payload_len", F.octet_length("payload"))
    first = {"decoded_offset": "first_decoded_offset", "compressed_byte_offset": "first_compressed_byte_offset", "payload": "first_payload", "payload_delta": "first_payload_delta"}
    return first_and_count(keyed, keys, first, "decoded_offset").orderBy(*keys)


def payload_variants(frames: DataFrame, arbitration: int, record_class: int | None = None, limit: int = 32) -> DataFrame:
    """Distinct payloads of one arbitration id: count and first occurrence, the first limit ones in key order."""
    kept = frames.where(F.col("arbitration_id") == arbitration)
    if record_class is not None:
        kept = kept.where(F.col("record_class") == record_class)
    first = {"timestamp_us": "first_timestamp_us", "decoded_offset": "first_decoded_offset", "compressed_byte_offset": "first_compressed_byte_offset", "payload_delta": "first_payload_delta"}
    return first_and_count(kept, ["record_class", "payload"], first, "decoded_offset").orderBy("record_class", "payload").limit(limit)


def running_sum_mod(rows: DataFrame, delta: str, by: list[str], order: str, modulus: int = 256) -> Column:
    """Running sum modulo modulus: what a byte of a payload is after its deltas."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(delta).over(w) % modulus


def disorder(rows: DataFrame, ts: str = "timestamp", seq: str = "seq", *, by: list[str]) -> DataFrame:
    """min and max of ts, how many rows stand below the largest before them in source order, and by how much at most.

    The running maximum is taken within by (a file); one file's order is a sequence, files are independent.
    """
    w = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("__before", F.max(ts).over(w))
    late = F.col(ts) < F.col("__before")
    agg = (F.min(ts).alias("min_timestamp"), F.max(ts).alias("max_timestamp"), F.count_if(late).alias("out_of_order_frames"), F.coalesce(F.max(F.when(late, F.col("__before") - F.col(ts))), F.lit(0)).alias("max_out_of_order_us"))
    return seen.groupBy(*by).agg(*agg)


def effective_window(configured: int, measured: int) -> int:
    """The window that lets no update be late: the larger of the configured and the measured one."""
    if configured < 0:
        raise InvalidArgument("the reorder window must not be negative")
    return max(configured, measured)


def buffer_peak(rows: DataFrame, window: int, ts: str = "timestamp", seq: str = "seq", *, by: list[str]) -> DataFrame:
    """The most distinct timestamps that a re-sequencing buffer of the given window holds at once.

    A timestamp t enters with its first row and leaves with the first row after which the running maximum exceeds
    t + window. Timestamps that come again after that are late and never held twice. Entries and exits are
    events on one line; the peak is the largest running sum.
    """
    w = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select(*by, F.col(ts).alias("t"), F.col(seq).alias("s")).withColumn("m", F.max("t").over(w.orderBy("s")))
    enter = seen.groupBy(*by, "t").agg(F.min("s").alias("at"))
    # the maximum grows in steps: the exit of t is the first step above t + window
    steps = seen.groupBy(*by, "m").agg(F.min("s").alias("at"))
    line = enter.select(*by, (F.col("t") + window).alias("x"), F.lit(1).alias("kind"), F.col("at")).unionByName(steps.select(*by, F.col("m").alias("x"), F.lit(0).alias("kind"), F.col("at")))
    # of equal x, a step is not above: steps come first, so that looking on from an entry finds larger ones only
    ahead = Window.partitionBy(*by).orderBy("x", "kind").rowsBetween(1, Window.unboundedFollowing)
    stays = line.withColumn("leave", F.first(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(ahead)).where("kind = 1 and (leave is null or leave > at)")
    # at the row where a timestamp leaves it no longer counts; that row's own timestamp does
    events = stays.select(*by, "at", F.lit(1).alias("d")).unionByName(stays.where("leave is not null").select(*by, F.col("leave").alias("at"), F.lit(-1).alias("d")))
    net = events.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    run = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = net.withColumn("held", F.sum("d").over(run))
    return held.groupBy(*by).agg(F.max("held").alias("peak"))


def require_buffer(rows: DataFrame, window: int, most: int, **names) -> int:
    """The largest peak of buffer_peak over all of by; more than most is an error, as is a most of 0."""
    if most < 1:
        raise InvalidArgument("the reorder buffer must hold a row")
    peak = buffer_peak(rows, window, **names).agg(F.max("peak")).first()[0] or 0
    if peak > most:
        raise ReorderBufferLimit(f"{peak} timestamps waiting, {most} allowed", pending=peak, limit=most)
    return peak


def semantic_stats(updates: DataFrame, ts: str = "timestamp", signal: str = "signal") -> DataFrame:
    return updates.agg(F.count("*").alias("updates"), F.count_distinct(ts).alias("rows"), F.count_distinct(signal).alias("signals"))


def version_rollup(versions: DataFrame, keys: list[str] = ("device", "record_class"), firmware: str = "firmware", pro: str = "pro") -> DataFrame:
    """Of each key's version records: whether majors conflict, and the largest firmware and any licence among those of the lowest major."""
    major = F.shiftrightunsigned(F.col(firmware), 24)
    rows = versions.where(F.col(firmware) != 0).withColumn("__major", major)
    per = rows.groupBy(*keys, "__major").agg(F.max(firmware).alias("firmware"), F.bool_or(pro).alias("is_pro"))
    return per.groupBy(*keys).agg(F.min_by(F.struct("firmware", "is_pro"), "__major").alias("x"), (F.count("*") > 1).alias("version_conflict")).select(*keys, "x.firmware", "x.is_pro", "version_conflict")


def standalone_payload(rows: DataFrame, value: str, by: list[str], order: str, record_class: str = "record_class") -> Column:
    """What a class-1 record reads: its own word, or for zero the last class-3 word of the same key before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cached = F.last(F.when(F.col(record_class) == 3, F.col(value)), ignorenulls=True).over(w)
    return F.when((F.col(record_class) == 1) & (F.col(value) == 0), F.coalesce(cached, F.col(value))).otherwise(F.col(value))

"""From physical records to signals, devices and updates."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.errors import SchemaError
from driftframe.functions import bits, catalog
from driftframe.operators import frames as fr
from driftframe.operators import tables as tb
from driftframe.sources import siglog, wire

ARMS = {
    "raw": "binary", "boolean": "boolean", "int64": "bigint", "float32": "float", "float64": "double", "string": "string", "boolean_array": "array<boolean>",
    "int64_array": "array<bigint>", "float32_array": "array<float>", "float64_array": "array<double>", "string_array": "array<string>",
}
_ARROW = {
    "raw": pa.binary(), "boolean": pa.bool_(), "int64": pa.int64(), "float32": pa.float32(), "float64": pa.float64(), "string": pa.string(), "boolean_array": pa.list_(pa.bool_()),
    "int64_array": pa.list_(pa.int64()), "float32_array": pa.list_(pa.float32()), "float64_array": pa.list_(pa.float64()), "string_array": pa.list_(pa.string()),
}
DATA, NAME, UNITS = 0, 1, 2


def custom_records(frames: DataFrame) -> DataFrame:
    """Custom records of a known subtype with their fields; a malformed descriptor or a payload too short fails the query."""
    f = bits.custom_fields("header")
    rows = frames.where(F.col("record_class") == bits.CUSTOM_CLASS).withColumns(f).where(F.col("subtype").isin(DATA, NAME, UNITS))
    bad = F.raise_error(F.concat(F.lit("InvalidCustomDescriptor: header "), F.hex("header"), F.lit(" at "), F.col("decoded_offset").cast("string"))).cast("binary")
    short = F.raise_error(F.concat(F.lit("InvalidCustomPayload: record at "), F.col("decoded_offset").cast("string"), F.lit(" is too short"))).cast("binary")
    exact = F.when(~F.col("descriptor_ok"), bad).when(F.col("exact_length") > F.octet_length("payload"), short).otherwise(F.expr("substring(payload, 1, cast(exact_length as int))"))
    return rows.withColumns({"exact": exact, "raw_id": bits.custom_raw_id("signal_index")})


def custom_signals(frames: DataFrame) -> DataFrame:
    """(path, raw_id, name, type_code, units, definition_decoded_offset): the last NAME of each index, and the last UNITS after it."""
    rows = custom_records(frames).where(F.col("subtype") != DATA)
    text = F.decode("exact", "UTF-8")  # malformed text fails
    names = rows.where(F.col("subtype") == NAME).groupBy("path", "raw_id").agg(F.max_by(F.struct(text.alias("name"), F.col("type_code").cast("int").alias("type_code"), F.col("decoded_offset").alias("at")), "decoded_offset").alias("x")).select("path", "raw_id", "x.*")
    units = rows.where(F.col("subtype") == UNITS).select("path", "raw_id", text.alias("units"), F.col("decoded_offset").alias("units_at"))
    joined = names.join(units, ["path", "raw_id"], "left")
    last = F.max_by(F.when(F.col("units_at") > F.col("at"), F.col("units")), F.when(F.col("units_at") > F.col("at"), F.col("units_at")))
    return joined.groupBy("path", "raw_id", "name", "type_code", F.col("at").alias("definition_decoded_offset")).agg(last.alias("units"))


def custom_updates(frames: DataFrame, signals: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """(path, timestamp_us, raw_id, name, decoded_offset, compressed_byte_offset, an arm for each type): data records with the type of their signal.

    Of selected names only, if given: other records never get to Python. A record without a definition fails the query.
    """
    rows = custom_records(frames).where(F.col("subtype") == DATA)
    joined = rows.join(signals.select("path", "raw_id", "name", F.col("type_code").alias("code")), ["path", "raw_id"], "left")
    if selected is not None:
        joined = joined.where(F.col("name").isNull() | F.col("name").isin(selected))
    code = F.when(F.col("code").isNull(), F.raise_error(F.concat(F.lit("MissingSignalDefinition: raw id "), F.col("raw_id").cast("string"))).cast("int")).otherwise(F.col("code"))
    keep = ["path", "timestamp_us", "raw_id", "name", "decoded_offset", "compressed_byte_offset"]

    def run(batches):
        for b in batches:
            cols: dict[str, list] = {a: [None] * b.num_rows for a in ARMS}
            for i, (c, raw) in enumerate(zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist())):
                arm, value = wire.decode_value(c, raw)
                cols[arm][i] = value
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(cols[a], _ARROW[a]) for a in ARMS)], [*keep, *ARMS])

    schema = "path string, timestamp_us long, raw_id long, name string, decoded_offset long, compressed_byte_offset long, " + ", ".join(f"{a} {t}" for a, t in ARMS.items())
    return joined.select(*keep, code.alias("code"), "exact").mapInArrow(run, schema)


def _device_frames(frames: DataFrame) -> DataFrame:
    """Records of classes 1 and 3 with device, base, length and word."""
    rows = frames.where(F.col("record_class").isin(1, 3)).withColumns({"device": bits.device_id("arbitration_id"), "base": bits.base_id("arbitration_id"), "length": F.octet_length("payload")})
    return rows.where(catalog.is_candidate(F.col("arbitration_id"), F.col("record_class"), F.col("length")))


def devices(frames: DataFrame) -> DataFrame:
    """(path, device_id, transport, firmware, is_pro, version_conflict, catalog_supported) of each device that reports its state.

    A device that sends bundles counts as CAN FD and needs a version of class 3, else it is not listed; others have that
    of class 1, if any. It is supported if its version has the catalog's major and majors do not conflict.
    """
    rows = _device_frames(frames)
    classic = F.bool_or((F.col("record_class") == 1) & (F.col("length") == 8) & F.col("base").isin(list(catalog.BUNDLED))).alias("classic")
    fd = F.bool_or((F.col("record_class") == 3) & (F.col("length") == 64) & (F.col("base") == catalog.BUNDLE_BASE)).alias("fd")
    seen = rows.groupBy("path", "device").agg(classic, fd).where("classic or fd")
    word = bits.word_le("payload", 6)
    versions = rows.where((F.col("length") == 6) & (F.col("base") == catalog.VERSION_BASE)).select("path", "device", "record_class", bits.extract(word, 0, 32).alias("firmware"), (bits.extract(word, 47, 1) == 1).alias("pro"))
    rolled = fr.version_rollup(versions, ["path", "device", "record_class"])
    chosen = seen.withColumn("record_class", F.when(F.col("fd"), 3).otherwise(1))
    found = chosen.join(rolled, ["path", "device", "record_class"], "left").where("not fd or firmware is not null")
    supported = F.coalesce((F.shiftrightunsigned("firmware", 24) == catalog.FIRMWARE_MAJOR) & ~F.col("version_conflict"), F.lit(False))
    return found.select(
        "path", F.col("device").alias("device_id"), F.when(F.col("fd"), "can_fd").otherwise("can2").alias("transport"), "firmware", F.coalesce("is_pro", F.lit(False)).alias("is_pro_licensed"),
        *(bits.extract("firmware", s, 8).cast("int").alias(f"firmware_{n}") for n, s in (("major", 24), ("minor", 16), ("bugfix", 8), ("build", 0))),
        F.coalesce("version_conflict", F.lit(False)).alias("version_conflict"), supported.alias("catalog_supported"),
    )


def enabled_frames(frames: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate records of supported devices that their transport lets through, with what the device says of itself."""
    rows = _device_frames(frames)
    own = found.where("catalog_supported").select("path", F.col("device_id").alias("device"), "transport", "firmware", "is_pro_licensed")
    rows = rows.join(own, ["path", "device"])
    fd = F.col("transport") == "can_fd"
    version = (F.col("length") == 6) & (F.col("record_class").isin(1) | fd)
    return rows.where((F.col("length") == 8) | (F.col("length") == 64) & fd | version)


def _groups() -> Column:
    """(grp, word) of a record: one, or all groups of a bundle."""
    one = F.array(F.struct(F.coalesce(*(F.when(F.col("base") == base, g) for g, (base, _, _) in catalog.GROUPS.items())).alias("grp"), F.when(F.col("length") == 6, bits.word_le("payload", 6)).otherwise(bits.word_le("payload", 8)).alias("word")))
    many = F.array(*(F.struct(F.lit(g).alias("grp"), bits.word_le(F.substring("payload", at + 1, 8)).alias("word")) for g, (_, _, at) in catalog.GROUPS.items() if at is not None))
    return F.when(F.col("length") == 64, many).otherwise(one)


def catalog_updates(frames: DataFrame, found: DataFrame) -> DataFrame:
    """(path, timestamp_us, raw_id, name, decoded_offset, compressed_byte_offset, float64, string, int64) of device signals.

    A class-1 record of a group outside the bundle that is all zero reads as the last class-3 word before it. A version without a
    number takes the device's. Every record also updates the device's timestamp, and its first one the reset count.
    """
    spark = frames.sparkSession
    keep = ["path", "device", "record_class", "decoded_offset", "compressed_byte_offset", "timestamp_us"]
    enabled = enabled_frames(frames, found)
    words = enabled.select(*keep, "firmware", "is_pro_licensed", F.explode(_groups()).alias("g")).select(*keep, "firmware", "is_pro_licensed", "g.*")
    alone = F.col("grp").isin("MOTOR_CONSTANTS", "FAULTS")
    words = words.withColumn("word", F.when(alone, fr.standalone_payload(words, "word", ["path", "device", "grp"], "decoded_offset")).otherwise(F.col("word")))
    own = F.col("firmware").bitwiseOR(F.shiftleft(F.col("is_pro_licensed").cast("long"), 47))
    words = words.withColumn("word", F.when((F.col("grp") == "VERSION") & (bits.extract("word", 0, 32) == 0), own).otherwise(F.col("word")))
    fields = words.join(F.broadcast(catalog.definitions(spark)), "grp")  # a fixed number of rows for each word
    raw = F.expr("shiftrightunsigned(word, shift) & (shiftleft(1L, width) - 1)")
    signed = F.expr("shiftright(shiftleft(raw, 64 - width), 64 - width)")
    pairs = [x for e, (texts, _) in catalog.ENUMS.items() for k, v in texts.items() for x in (F.lit(f"{e}:{k}"), F.lit(v))]
    rest = [x for e, (_, d) in catalog.ENUMS.items() for x in (F.lit(e), F.lit(d))]
    text = F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws(":", "texts", F.col("raw").cast("string"))), F.try_element_at(F.create_map(*rest), F.col("texts")))
    fields = fields.withColumn("raw", raw)
    number = F.when(F.col("kind") == "F", bits.float_from_bits(F.expr("shiftleft(raw, 32 - width)"))).when(F.col("kind") != "T", F.when(F.col("kind") == "S", signed).otherwise(F.col("raw")).cast("double") * F.col("scale") + F.col("bias"))
    named = F.concat(F.lit("device_"), F.col("device").cast("string"), F.lit("_"), F.col("column"))
    out = fields.select("path", "timestamp_us", bits.catalog_raw_id("spn", "device").alias("raw_id"), named.alias("name"), "decoded_offset", "compressed_byte_offset", number.alias("float64"), F.when(F.col("kind") == "T", text).alias("string"), F.lit(None).cast("long").alias("int64"))
    book = enabled.select(*keep)
    prefix = F.concat(F.lit("device_"), F.col("device").cast("string"))
    times = book.select("path", "timestamp_us", bits.timestamp_raw_id("device").alias("raw_id"), F.concat(prefix, F.lit("_timestamp")).alias("name"), "decoded_offset", "compressed_byte_offset", bits.seconds("timestamp_us").alias("float64"), F.lit(None).cast("string").alias("string"), F.lit(None).cast("long").alias("int64"))
    first = book.groupBy("path", "device").agg(F.min_by(F.struct("timestamp_us", "decoded_offset", "compressed_byte_offset"), "decoded_offset").alias("x")).select("path", "device", "x.*")
    resets = first.select("path", "timestamp_us", bits.reset_raw_id("device").alias("raw_id"), F.concat(prefix, F.lit("_reset_count")).alias("name"), "decoded_offset", "compressed_byte_offset", F.lit(None).cast("double").alias("float64"), F.lit(None).cast("string").alias("string"), F.lit(0).cast("long").alias("int64"))
    return out.unionByName(times).unionByName(resets)


#: Fixed values of the format's output.
CUSTOM, CATALOG, DEVICE_PREFIX = "custom", "phoenix_can", "TalonFX-"


class Log:
    """One or more logs: records are decoded once and kept until close(); signals, devices and tables follow from them.

    Everything is by path: logs define their signals each for itself. Tables of several logs have a column for each name; a name
    must have one type in all of them.
    """

    def __init__(self, frames: DataFrame, header: DataFrame | None = None):
        self.frames, self.header = frames.persist(), header
        self.customs = custom_signals(self.frames)
        self.devices = devices(self.frames)
        self._updates: DataFrame | None = None

    def close(self) -> None:
        for kept in (self._updates, self.frames):
            if kept is not None:
                kept.unpersist()
        self._updates = None

    def _long(self, selected: list[str] | None = None) -> DataFrame:
        a = custom_updates(self.frames, self.customs, selected)
        b = catalog_updates(self.frames, self.devices)
        return a.unionByName(b if selected is None else b.where(F.col("name").isin(selected)), allowMissingColumns=True)

    def updates(self, ordered: bool = False) -> DataFrame:
        """The long table, not re-sequenced: (path, timestamp_us, raw_id, name, decoded_offset, an arm for each type).

        In the order of each file if ordered, those of one record by raw_id; else in no order. Kept after the first use.
        """
        if self._updates is None:
            self._updates = self._long().persist()
        return self._updates.orderBy("path", "decoded_offset", "raw_id") if ordered else self._updates

    def catalog_frames(self) -> DataFrame:
        """(path, arbitration_id, record_class, payload_len, first_decoded_offset): variants of records that the catalog decodes, by first offset."""
        rows = enabled_frames(self.frames, self.devices).withColumnRenamed("length", "payload_len")
        keys = ["path", "arbitration_id", "record_class", "payload_len"]
        return rows.groupBy(*keys).agg(F.min("decoded_offset").alias("first_decoded_offset")).orderBy("path", "first_decoded_offset")

    def _seen(self) -> DataFrame:
        """(path, raw_id, name, definition_decoded_offset, spn) of the signals of the groups seen, from a row for each group of a device."""
        spark = self.frames.sparkSession
        enabled = enabled_frames(self.frames, self.devices).select("path", "device", "base", "length", "payload", "decoded_offset")
        groups = enabled.select("path", "device", "decoded_offset", F.explode(F.transform(_groups(), lambda g: g["grp"])).alias("grp"))
        first = groups.groupBy("path", "device", "grp").agg(F.min("decoded_offset").alias("at"))
        fields = first.join(F.broadcast(catalog.definitions(spark).select("grp", "spn", "column")), "grp")
        prefix = F.concat(F.lit("device_"), F.col("device").cast("string"), F.lit("_"))
        known = fields.select("path", bits.catalog_raw_id("spn", "device").alias("raw_id"), F.concat(prefix, F.col("column")).alias("name"), F.col("at").alias("definition_decoded_offset"), "spn")
        own, none = first.groupBy("path", "device").agg(F.min("at").alias("at")), F.lit(None).cast("long").alias("spn")
        for raw_id, leaf in ((bits.timestamp_raw_id("device"), "timestamp"), (bits.reset_raw_id("device"), "reset_count")):
            known = known.unionByName(own.select("path", raw_id.alias("raw_id"), F.concat(prefix, F.lit(leaf)).alias("name"), F.col("at").alias("definition_decoded_offset"), none))
        return known

    def signals(self) -> DataFrame:
        """The dictionary of each log, in order of raw_id: custom signals and those of the groups that were seen."""
        spark = self.frames.sparkSession
        types = F.create_map(*(x for c, (t, _) in wire.TYPES.items() for x in (F.lit(c), F.lit(t))))
        labels = F.create_map(*(x for c, (_, t) in wire.TYPES.items() for x in (F.lit(c), F.lit(t))))
        code = F.col("type_code")
        unknown = F.concat(F.lit("unknown/0x"), F.lower(F.lpad(F.hex(code), 2, "0")))
        customs = self.customs.select(
            "path", "raw_id", "name", F.coalesce(F.try_element_at(types, code), F.lit("unknown")).alias("signal_type"), F.coalesce(F.try_element_at(labels, code), unknown).alias("original_type"),
            F.coalesce("units", F.lit("")).alias("units"), bits.units_metadata("units").alias("metadata"), F.lit(CUSTOM).alias("source"), F.lit("full").alias("support"),
            F.lit(None).cast("string").alias("device"), "definition_decoded_offset",
        )
        units = catalog.definitions(spark).select("spn", F.col("units").alias("u"), F.col("kind").alias("k"))
        known = self._seen().join(F.broadcast(units), "spn", "left")
        kind = F.when(F.col("name").endswith("_reset_count") & F.col("k").isNull(), "int64").when(F.col("k") == "T", "string").otherwise("float64")
        device = F.shiftrightunsigned("raw_id", 8).bitwiseAND(F.lit(63).cast("long")).cast("string")
        made = known.select(
            "path", "raw_id", "name", kind.alias("signal_type"), F.when(kind == "float64", "double").otherwise(kind).alias("original_type"),
            F.coalesce("u", F.when(F.col("name").endswith("_timestamp"), "seconds").otherwise("")).alias("units"), F.lit("{}").alias("metadata"), F.lit(CATALOG).alias("source"), F.lit("full").alias("support"),
            F.concat(F.lit(DEVICE_PREFIX), device).alias("device"), "definition_decoded_offset",
        )
        both = customs.unionByName(made)
        if self.header is None:
            both = both.withColumn("bus", F.lit(None).cast("string"))
        else:
            both = both.join(self.header.select("path", F.col("source").alias("bus")), "path", "left")
        return both.orderBy("path", "raw_id")

    def _columns(self, selected: list[str] | None = None) -> list[tuple[str, str, str]]:
        """(name, type, group) of each column, in order of raw_id."""
        grp = F.coalesce(F.concat(F.lit("device/"), F.col("device")), F.lit("custom"))
        own = self.signals().groupBy("path", "name").agg(F.count("*").alias("n"), F.min("raw_id").alias("raw_id"), F.first("signal_type").alias("signal_type"), F.first(grp).alias("grp"))
        rows = own.groupBy("name").agg(F.max("n").alias("n"), F.min("raw_id").alias("raw_id"), F.sort_array(F.collect_set("signal_type")).alias("types"), F.min("grp").alias("grp"))
        rows = rows.orderBy("raw_id", "name").collect()  # a row for each column of the table to make
        chosen = set(tb.check_names([r["name"] for r in rows for _ in range(r["n"])], selected))
        rows = [r for r in rows if r["name"] in chosen]
        for r in rows:
            if len(r["types"]) > 1:
                raise SchemaError(f"signal {r['name']} has the types {', '.join(r['types'])} in different logs", name=r["name"])
            if r["types"] == ["unknown"]:
                raise SchemaError(f"signal {r['name']} has an unknown type", name=r["name"])
        return [(r["name"], r["types"][0], r["grp"]) for r in rows]

    def _sparse(self, columns: list[tuple[str, str, str]], selected: list[str] | None, sequence: str | None, with_path: bool) -> DataFrame:
        arms: dict[str, list[str]] = {}
        for name, kind, _ in columns:
            arms.setdefault(kind, []).append(name)
        u = (self._long(selected) if selected is not None else self.updates()).withColumnRenamed("timestamp_us", "timestamp")
        u = u.withColumn("string", F.coalesce("string", F.make_valid_utf8(F.col("raw").cast("string"))))
        keys, extra = ["path", "timestamp"] if with_path else ["timestamp"], [sequence] if sequence else []
        if not arms:
            return u.select(*keys).limit(0)
        out = tb.sparse(u, arms, ("path", "timestamp"), "name", "decoded_offset", sequence)
        ordered = out.orderBy("path", "timestamp") if with_path else out.orderBy("timestamp", "path")
        return ordered.select(*keys, *extra, *(F.col(f"`{name}`") for name, _, _ in columns))

    def wide(self, selected: list[str] | None = None, with_path: bool = False) -> DataFrame:
        """timestamp and a column for each signal (or each selected one), the last update of each timestamp of each log.

        Logs are not merged: with_path tells their rows apart.
        """
        return self._sparse(self._columns(selected), selected, None, with_path)

    def narrow(self, with_path: bool = False) -> dict[str, DataFrame]:
        """A table for the custom signals and one for each device, with source_sequence."""
        columns = self._columns()
        groups = {g: [c for c in columns if c[2] == g] for g in sorted({c[2] for c in columns})}
        return {g: self._sparse(own, None, "source_sequence", with_path) for g, own in groups.items()}

    def batches(self, rows: int, call, selected: list[str] | None = None, with_path: bool = False) -> pa.Schema:
        """call(Arrow table) with just rows rows of wide() each, in order, the last with fewer; the table's schema."""
        table = self.wide(selected, with_path)
        tb.batches(table, rows, call)
        return tb.to_arrow_schema(table.schema)

    def narrow_batches(self, rows: int, call, with_path: bool = False) -> pa.Schema:
        """call(group, Arrow table) with batches of each table of narrow(), group after group; the schema of their union."""
        tables = self.narrow(with_path)
        for group, table in tables.items():
            tb.batches(table, rows, lambda batch: call(group, batch))  # noqa: B023 - called at once
        return tb.to_arrow_schema(tb.union_narrow(list(tables.values())).schema) if tables else pa.schema([("timestamp", pa.int64()), ("source_sequence", pa.int64())])

    def unsupported(self) -> DataFrame:
        """Records of classes other than 7 that nothing decodes, rolled up for each log."""
        keys = ["path", "arbitration_id", "record_class", "length"]
        known = enabled_frames(self.frames, self.devices).select(*keys).distinct()  # what decodes depends on nothing else
        rest = self.frames.where(F.col("record_class") != bits.CUSTOM_CLASS).withColumn("length", F.octet_length("payload"))
        return fr.unsupported_rollup(rest.join(known, keys, "left_anti"), ["path"])

    def report(self) -> dict:
        """Counters, timestamps' range and disorder, devices, signals and unsupported records."""
        counts = self.frames.agg(F.count("*").alias("raw_frames"), F.count_if(F.col("record_class") == bits.CUSTOM_CLASS).alias("custom_frames")).first()
        at = ["path", "timestamp_us", "decoded_offset"]
        data = custom_records(self.frames).where(F.col("subtype") == DATA).select(*at).unionByName(_device_frames(self.frames).select(*at))
        of_logs = fr.disorder(data, "timestamp_us", "decoded_offset", by=["path"])
        ends = [F.min("min_timestamp").alias("min_timestamp"), F.max("max_timestamp").alias("max_timestamp")]
        d = of_logs.agg(*ends, F.sum("out_of_order_frames").alias("out_of_order_frames"), F.max("max_out_of_order_us").alias("max_out_of_order_us")).first()
        out = counts.asDict() | {k: v if v is not None or k.startswith("m") and k.endswith("timestamp") else 0 for k, v in d.asDict().items()}
        return out | {n: [r.asDict() for r in df.collect()] for n, df in (("signals", self.signals()), ("devices", self.devices), ("unsupported", self.unsupported()))}

    def check_order(self, window: int, most: int) -> int:
        """The most timestamps of a log that wait at once in a re-sequencing buffer, its window widened to the log's own disorder."""
        u = self.updates()
        measured = fr.disorder(u, "timestamp_us", "decoded_offset", by=["path"]).agg(F.max("max_out_of_order_us")).first()[0] or 0
        return fr.require_buffer(u, fr.effective_window(window, measured), most, ts="timestamp_us", seq="decoded_offset", by=["path"])


def open_log(spark: SparkSession, path: str, tail: str = "lenient", codebook: str = "") -> Log:
    """The log or logs at path: by the data source where the session's executors are this machine and the path is a file here."""
    local = os.path.exists(path) and spark.sparkContext.master.startswith("local")
    read = siglog.scan if local else siglog.read_logs
    return Log(read(spark, path, "frames", tail, codebook), read(spark, path, "header", tail, codebook))

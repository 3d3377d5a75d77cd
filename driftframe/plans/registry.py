"""The operators on the driver's tables, each with the same query in DuckDB's SQL.

events stands for a log of signal updates: timestamp is its ts in buckets of an hour, signal its type, device its user
modulo 4, and seq a permutation of event_id, so that rows come out of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.functions import bits, catalog
from driftframe.operators import frames as fr
from driftframe.operators import tables as tb

HOUR = 3_600_000_000
SIGNALS = ["click", "error", "purchase", "signup", "view"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return _read(spark, sf_dir, "events").select(
        (F.floor(micros / HOUR) * HOUR).cast("long").alias("timestamp"), F.col("event_type").alias("signal"), F.concat(F.lit("dev-"), (F.col("user_id") % 4).cast("string")).alias("device"),
        "value", F.col("event_id").bitwiseXOR(F.lit(7).cast("long")).alias("seq"), micros.alias("us"), "user_id", "event_id", "props",
    )


U = f"""u AS (SELECT epoch_us(ts) // {HOUR} * {HOUR} AS timestamp, event_type AS signal, 'dev-' || (user_id % 4) AS device, value, xor(event_id, 7) AS seq, epoch_us(ts) AS us, user_id, event_id, props FROM events)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit word for each lineitem."""
    word = F.expr("shiftleft(l_orderkey, 40) ^ shiftleft(l_partkey, 20) ^ shiftleft(l_suppkey, 7) ^ cast(l_linenumber as long)")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", word.alias("word"))


W = "w AS (SELECT l_orderkey, l_linenumber, xor(xor(xor(l_orderkey << 40, l_partkey << 20), l_suppkey << 7), l_linenumber::BIGINT) AS word FROM lineitem)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = updates(spark, sf_dir)
    header = (F.col("user_id") * 67 + F.shiftleft(F.col("event_id") % 8, 29)).alias("header")
    return u.select(header, F.col("seq").alias("decoded_offset"), (F.col("seq") * 3).alias("compressed_byte_offset"), F.encode("props", "UTF-8").alias("payload"), F.encode("signal", "UTF-8").alias("payload_delta"), F.col("us").alias("timestamp_us")).withColumns({"arbitration_id": bits.arbitration_id("header"), "record_class": bits.record_class("header")})


FR = f"{U}, fr AS (SELECT h AS header, h & 536870911 AS arbitration_id, (h >> 29)::INTEGER AS record_class, seq AS decoded_offset, seq * 3 AS compressed_byte_offset, props AS payload, signal AS payload_delta, us AS timestamp_us FROM (SELECT *, user_id * 67 + ((event_id % 8) << 29) AS h FROM u))"

ENABLED = ((1, 67), (3, 134), (3, 335), (5, 469))


def _keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENABLED, "record_class int, arbitration_id long")


K = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in ENABLED) + ") AS t(record_class, arbitration_id))"
_cols = ", ".join(f"arg_max(value, seq) FILTER (WHERE signal = '{s}') AS {s}" for s in SIGNALS)
_two = ", ".join(f"arg_max(value, seq) FILTER (WHERE signal = '{s}') AS {s}" for s in SIGNALS[:2])


_has = {s: ", ".join(f"'dev-{i}'" for i in range(4) if s in SIGNALS[i : i + 2]) for s in SIGNALS}
_four = ", ".join(f"arg_max(value, seq) FILTER (WHERE signal = '{s}' AND device IN ({g})) AS {s}" for s, g in _has.items())
_owned = " OR ".join(f"signal = '{s}' AND device IN ({g})" for s, g in _has.items())


def _narrow_union(spark, d):
    groups = {f"dev-{i}": SIGNALS[i : i + 2] for i in range(4)}
    made = tb.narrow_all(updates(spark, d), groups, order=False)
    return tb.union_narrow([made[g].select(F.lit(g).alias("device"), "*") for g in sorted(made)])


def _filled(spark, d):
    t = tb.wide(updates(spark, d), SIGNALS, by=("device", "timestamp"), order=False)
    return tb.forward_fill(t, SIGNALS, ["timestamp"], ["device"])


def _versions(spark, d):
    u = updates(spark, d)
    version = ((F.col("user_id") % 3 + 25) * 16777216 + F.col("event_id") % 65536).alias("firmware")
    return fr.version_rollup(u.select("device", "signal", version, (F.col("event_id") % 5 == 0).alias("pro")), ["device", "signal"])


GROUPS = list(catalog.GROUPS)


def _unpivot(spark, d):
    """The fields of every word; its group goes by its order and line."""
    raw = F.expr("shiftrightunsigned(word, shift) & (shiftleft(1L, width) - 1)")
    n = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(GROUPS))).cast("int")
    w = words(spark, d).withColumn("grp", F.element_at(F.array(*map(F.lit, GROUPS)), n + 1))
    return w.join(F.broadcast(catalog.definitions(spark)), "grp").select("l_orderkey", "l_linenumber", "grp", "spn", "column", raw.alias("raw"))


#: Where in a word the code of each text map is read: six bits each.
ENUM_AT = {name: 6 * i for i, name in enumerate(catalog.ENUMS)}


def _enum(spark, d):
    w = words(spark, d)
    return w.select("l_orderkey", "l_linenumber", *(catalog.enum_text(name, bits.extract("word", at, 6)).alias(name) for name, at in ENUM_AT.items()))


def _enum_sql() -> str:
    def case(name: str, at: int) -> str:
        texts, default = catalog.ENUMS[name]
        return f"CASE (word >> {at}) & 63 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in texts.items()) + f" ELSE '{default}' END AS \"{name}\""

    return f"WITH {W} SELECT l_orderkey, l_linenumber, {', '.join(case(*x) for x in ENUM_AT.items())} FROM w"


def _arrays(spark, d):
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 8).cast("int") - 1), lambda i: F.substring(F.col("text"), i * 8 + 1, F.lit(8)))
    return _read(spark, d, "benchmark").select("item_id", F.array_join(F.when(F.length("text") >= 8, chunks).otherwise(F.array()), "|").alias("chunks"))


def _roundtrip(spark, d):
    from driftframe.sources.sinks import scratch, write_table

    path = scratch(spark, "roundtrip")
    write_table(tb.wide(updates(spark, d), SIGNALS, order=False), path, "zstd")
    return spark.read.parquet(path)


def _fields(spark, d):
    f = bits.custom_fields("h")
    w = words(spark, d).withColumn("h", F.col("word").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return w.select("l_orderkey", "l_linenumber", *(c.cast("long").alias(n) if n != "descriptor_ok" else c.alias(n) for n, c in f.items()))


def _updates_union(spark, d):
    u = updates(spark, d)
    a = u.where("signal in ('click', 'view')").select("seq", "timestamp", F.lit("custom").alias("origin"), "value")
    b = u.where("signal not in ('click', 'view')").select("seq", "timestamp", F.lit("catalog").alias("origin"), (F.col("value") * 2).alias("value"))
    return a.unionByName(b).orderBy("seq")


def _lookup(spark, d):
    names = spark.createDataFrame([(s, i) for i, s in enumerate(SIGNALS)], "signal string, raw_id long")
    found = updates(spark, d).join(F.broadcast(names), "signal", "left")
    return found.select("seq", F.when(F.col("raw_id").isNull(), F.raise_error(F.lit("no definition"))).otherwise(F.col("raw_id")).alias("raw_id"), "value")


def _modular(spark, d):
    u = updates(spark, d).withColumn("delta", F.pmod(F.col("event_id") * 31, F.lit(256)))
    return u.select("seq", "device", fr.running_sum_mod(u, "delta", ["device", "signal"], "seq").alias("byte"))


def _asof(spark, d):
    u = updates(spark, d).withColumns({"record_class": F.when(F.col("event_id") % 3 == 0, 3).otherwise(1), "word": F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("event_id"))})
    return u.select("seq", fr.standalone_payload(u, "word", ["device", "signal"], "seq").cast("long").alias("word"))


def _reset(spark, d):
    first = F.row_number().over(Window.partitionBy("device").orderBy("seq"))
    return updates(spark, d).withColumn("n", first).where("n = 1").select("device", "seq", "timestamp", F.lit(0).cast("long").alias("reset_count"))


def _float_bits(spark, d):
    b = bits.extract("word", 20, 32)
    return words(spark, d).select("l_orderkey", "l_linenumber", bits.float_from_bits(b).alias("value"))


_B = "((word >> 20) & 4294967295)"
QUERIES = {
    "sparse_wide": (lambda s, d: tb.wide(updates(s, d), SIGNALS), f"WITH {U} SELECT timestamp, {_cols} FROM u GROUP BY timestamp"),
    "sparse_selected": (lambda s, d: tb.wide(updates(s, d), tb.check_names(SIGNALS, ["click", "error"])), f"WITH {U} SELECT timestamp, {_two} FROM u WHERE signal IN ('click', 'error') GROUP BY timestamp"),
    "narrow_group_custom": (lambda s, d: tb.narrow(updates(s, d).withColumn("device", F.lit("custom")), "custom", SIGNALS), f"WITH {U} SELECT timestamp, max(seq) AS source_sequence, {_cols} FROM u GROUP BY timestamp"),
    "narrow_device": (lambda s, d: tb.narrow(updates(s, d), "dev-1", SIGNALS), f"WITH {U} SELECT timestamp, max(seq) AS source_sequence, {_cols} FROM u WHERE device = 'dev-1' GROUP BY timestamp"),
    "narrow_union": (_narrow_union, f"WITH {U} SELECT device, timestamp, max(seq) AS source_sequence, {_four} FROM u WHERE {_owned} GROUP BY device, timestamp"),
    "forward_fill": (_filled, f"WITH {U}, t AS (SELECT device, timestamp, {_cols} FROM u GROUP BY device, timestamp) SELECT device, timestamp, " + ", ".join(f"last_value({s} IGNORE NULLS) OVER (PARTITION BY device ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS {s}" for s in SIGNALS) + " FROM t"),
    "collapse_equal_ts": (lambda s, d: tb.collapse_equal(updates(s, d).select("timestamp", F.col("seq").alias("source_sequence"), "signal", "value")), f"WITH {U} SELECT timestamp, seq AS source_sequence, signal, value FROM u QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY seq DESC) = 1"),
    "disorder_stats": (lambda s, d: fr.disorder(updates(s, d), "us", by=["device"]), f"WITH {U}, m AS (SELECT *, max(us) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u) SELECT device, min(us) AS min_timestamp, max(us) AS max_timestamp, count(*) FILTER (WHERE us < b) AS out_of_order_frames, coalesce(max(b - us) FILTER (WHERE us < b), 0) AS max_out_of_order_us FROM m GROUP BY device"),
    "reorder_buffer_audit": (lambda s, d: fr.buffer_peak(updates(s, d), 5 * HOUR, by=["device"]), f"WITH {U}, s AS (SELECT device, timestamp AS t, seq, max(timestamp) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM u), e AS (SELECT device, t, min(seq) AS f FROM s GROUP BY device, t) SELECT device, max(c) AS peak FROM (SELECT s.device AS device, s.seq, count(*) AS c FROM s JOIN e ON s.device = e.device AND e.f <= s.seq AND e.t >= s.m - {5 * HOUR} GROUP BY s.device, s.seq) GROUP BY device"),
    "semantic_stats": (lambda s, d: fr.semantic_stats(updates(s, d)), f'WITH {U} SELECT count(*) AS updates, count(DISTINCT timestamp) AS "rows", count(DISTINCT signal) AS signals FROM u'),
    "key_first_count": (lambda s, d: fr.first_and_count(frames(s, d), ["arbitration_id", "record_class"], {"decoded_offset": "first_decoded_offset", "timestamp_us": "first_timestamp_us"}, "decoded_offset"), f"WITH {FR} SELECT arbitration_id, record_class, count(*) AS count, min(decoded_offset) AS first_decoded_offset, arg_min(timestamp_us, decoded_offset) AS first_timestamp_us FROM fr GROUP BY ALL"),
    "payload_variants": (lambda s, d: fr.payload_variants(frames(s, d), 134).withColumns({"payload": F.decode("payload", "UTF-8"), "first_payload_delta": F.decode("first_payload_delta", "UTF-8")}), f"WITH {FR} SELECT record_class, payload, count(*) AS count, arg_min(timestamp_us, decoded_offset) AS first_timestamp_us, min(decoded_offset) AS first_decoded_offset, arg_min(compressed_byte_offset, decoded_offset) AS first_compressed_byte_offset, arg_min(payload_delta, decoded_offset) AS first_payload_delta FROM fr WHERE arbitration_id = 134 GROUP BY record_class, payload ORDER BY record_class, payload LIMIT 32"),
    "unsupported_rollup": (lambda s, d: fr.unsupported_rollup(frames(s, d).join(F.broadcast(_keys(s)), ["record_class", "arbitration_id"], "left_anti")).withColumns({"first_payload": F.decode("first_payload", "UTF-8"), "first_payload_delta": F.decode("first_payload_delta", "UTF-8")}), f"WITH {FR}, {K} SELECT arbitration_id, record_class, strlen(payload)::INTEGER AS payload_len, count(*) AS count, min(decoded_offset) AS first_decoded_offset, arg_min(compressed_byte_offset, decoded_offset) AS first_compressed_byte_offset, arg_min(payload, decoded_offset) AS first_payload, arg_min(payload_delta, decoded_offset) AS first_payload_delta FROM fr ANTI JOIN k USING (record_class, arbitration_id) GROUP BY ALL"),
    "unsupported_anti": (lambda s, d: frames(s, d).join(F.broadcast(_keys(s)), ["record_class", "arbitration_id"], "left_anti").select("arbitration_id", "record_class", "decoded_offset"), f"WITH {FR}, {K} SELECT arbitration_id, record_class, decoded_offset FROM fr ANTI JOIN k USING (record_class, arbitration_id)"),
    "enabled_semi": (lambda s, d: frames(s, d).join(F.broadcast(_keys(s)), ["record_class", "arbitration_id"], "left_semi").select("arbitration_id", "record_class", "decoded_offset"), f"WITH {FR}, {K} SELECT arbitration_id, record_class, decoded_offset FROM fr SEMI JOIN k USING (record_class, arbitration_id)"),
    "frames_filter": (lambda s, d: frames(s, d).where("arbitration_id = 67 and record_class = 1").select("decoded_offset", "timestamp_us"), f"WITH {FR} SELECT decoded_offset, timestamp_us FROM fr WHERE arbitration_id = 67 AND record_class = 1"),
    "frame_counters": (lambda s, d: frames(s, d).agg(F.count("*").alias("raw_frames"), F.count_if(F.col("record_class") == 7).alias("custom_frames")), f"WITH {FR} SELECT count(*) AS raw_frames, count(*) FILTER (WHERE record_class = 7) AS custom_frames FROM fr"),
    "version_rollup": (_versions, f"WITH {U}, v AS (SELECT device, signal, (user_id % 3 + 25) AS major, (user_id % 3 + 25) * 16777216 + event_id % 65536 AS fw, event_id % 5 = 0 AS pro FROM u), l AS (SELECT *, min(major) OVER (PARTITION BY device, signal) AS low FROM v) SELECT device, signal, max(fw) FILTER (WHERE major = low) AS firmware, bool_or(pro) FILTER (WHERE major = low) AS is_pro, count(DISTINCT major) > 1 AS version_conflict FROM l GROUP BY device, signal"),
    "modular_delta": (_modular, f"WITH {U} SELECT seq, device, (sum((event_id * 31) % 256) OVER (PARTITION BY device, signal ORDER BY seq ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS byte FROM u"),
    "asof_standalone": (_asof, f"WITH {U}, x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END AS c, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS w FROM u) SELECT seq, CASE WHEN c = 1 AND w = 0 THEN coalesce(last_value(CASE WHEN c = 3 THEN w END IGNORE NULLS) OVER (PARTITION BY device, signal ORDER BY seq ROWS UNBOUNDED PRECEDING), w) ELSE w END AS word FROM x"),
    "first_per_device_reset": (_reset, f"WITH {U} SELECT device, seq, timestamp, 0::BIGINT AS reset_count FROM u QUALIFY row_number() OVER (PARTITION BY device ORDER BY seq) = 1"),
    "bitfield_unsigned": (lambda s, d: words(s, d).select("l_orderkey", "l_linenumber", bits.extract("word", 21, 17).alias("field")), f"WITH {W} SELECT l_orderkey, l_linenumber, (word >> 21) & 131071 AS field FROM w"),
    "bitfield_signed": (lambda s, d: words(s, d).select("l_orderkey", "l_linenumber", bits.sign_extend(bits.extract("word", 20, 10), 10).alias("field")), f"WITH {W} SELECT l_orderkey, l_linenumber, CASE WHEN ((word >> 20) & 1023) >= 512 THEN ((word >> 20) & 1023) - 1024 ELSE (word >> 20) & 1023 END AS field FROM w"),
    "bitfield_scaled": (lambda s, d: words(s, d).select("l_orderkey", "l_linenumber", bits.scaled(bits.extract("word", 30, 10), 0.025, 4.0).alias("field")), f"WITH {W} SELECT l_orderkey, l_linenumber, ((word >> 30) & 1023)::DOUBLE * 0.025::DOUBLE + 4.0::DOUBLE AS field FROM w"),
    "float_from_bits": (_float_bits, f"WITH {W}, b AS (SELECT l_orderkey, l_linenumber, {_B} >> 31 AS s, ({_B} >> 23) & 255 AS e, {_B} & 8388607 AS f FROM w) SELECT l_orderkey, l_linenumber, CASE WHEN e = 255 THEN CASE WHEN f <> 0 THEN 'NaN'::DOUBLE WHEN s = 1 THEN '-Infinity'::DOUBLE ELSE 'Infinity'::DOUBLE END WHEN e = 0 THEN (CASE s WHEN 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * f::DOUBLE * pow(2.0::DOUBLE, -149) ELSE (CASE s WHEN 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (1.0::DOUBLE + f / 8388608.0::DOUBLE) * pow(2.0::DOUBLE, e - 127) END AS value FROM b"),
    "dlc_length": (lambda s, d: words(s, d).select("l_orderkey", "l_linenumber", bits.dlc_length(bits.extract("word", 20, 4)).alias("bytes")), f"WITH {W} SELECT l_orderkey, l_linenumber, [{', '.join(map(str, bits.DLC_LENGTHS))}][((word >> 20) & 15) + 1]::INTEGER AS bytes FROM w"),
    "custom_header_fields": (_fields, f"WITH {W}, h AS (SELECT *, word & 4294967295 AS h FROM w), x AS (SELECT *, (h >> 8) & 65535 AS desc_, h & 255 AS i FROM h) SELECT l_orderkey, l_linenumber, i AS signal_index, (desc_ & 15) = 0 AND i <> 0 AS descriptor_ok, ((desc_ >> 4) // 64) * 4 AS type_code, (desc_ >> 4) % 64 AS exact_length, (h >> 24) & 31 AS subtype FROM x"),
    "enum_text": (_enum, _enum_sql()),
    "leaf_name": (lambda s, d: _read(s, d, "part").select("p_partkey", bits.snake_name(F.concat("p_name", F.lit("Motor"), "p_brand", F.lit("CANcoder"))).alias("name")), r"SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || 'Motor' || p_brand || 'CANcoder', '[^A-Za-z0-9]+', '_', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g')) AS name FROM part"),
    "definition_unpivot": (_unpivot, None),
    "update_union": (_updates_union, f"WITH {U} SELECT seq, timestamp, 'custom' AS origin, value FROM u WHERE signal IN ('click', 'view') UNION ALL SELECT seq, timestamp, 'catalog', value * 2 FROM u WHERE signal NOT IN ('click', 'view')"),
    "definition_lookup": (_lookup, f"WITH {U}, n AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {i})' for i, x in enumerate(SIGNALS))}) AS t(signal, raw_id)) SELECT seq, raw_id::BIGINT AS raw_id, value FROM u JOIN n USING (signal)"),
    "raw_ids": (lambda s, d: _read(s, d, "part").select("p_partkey", bits.custom_raw_id(F.col("p_size")).alias("custom_id"), bits.catalog_raw_id(F.col("p_partkey"), F.col("p_size")).alias("catalog_id"), bits.timestamp_raw_id(F.col("p_size")).alias("timestamp_id"), bits.reset_raw_id(F.col("p_size")).alias("reset_id")), "SELECT p_partkey, (p_size::BIGINT << 16) | 65280 AS custom_id, (p_partkey << 16) | (p_size::BIGINT << 8) AS catalog_id, 4261412864 | (p_size::BIGINT << 8) AS timestamp_id, 4261412865 | (p_size::BIGINT << 8) AS reset_id FROM part"),
    "device_split": (lambda s, d: frames(s, d).select("decoded_offset", bits.device_id("arbitration_id").alias("device"), bits.base_id("arbitration_id").alias("base")), f"WITH {FR} SELECT decoded_offset, (arbitration_id & 63)::INTEGER AS device, arbitration_id & ~63 AS base FROM fr"),
    "firmware_parts": (lambda s, d: words(s, d).select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in bits.firmware_parts("word").items())), f"WITH {W} SELECT l_orderkey, l_linenumber, (word >> 24) & 255 AS major, (word >> 16) & 255 AS minor, (word >> 8) & 255 AS bugfix, word & 255 AS build FROM w"),
    "units_metadata": (lambda s, d: _read(s, d, "part").select("p_partkey", bits.units_metadata(F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit('"')))).alias("metadata")), """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"units": "' || p_brand || '\\""}' ELSE '{}' END AS metadata FROM part"""),
    "array_chunks": (_arrays, "SELECT item_id, coalesce(array_to_string(list_transform(range(0, length(text) // 8), lambda i: substr(text, i::INTEGER * 8 + 1, 8)), '|'), '') AS chunks FROM benchmark"),
    "ts_seconds": (lambda s, d: updates(s, d).select("seq", bits.seconds("us").alias("seconds")), f"WITH {U} SELECT seq, us / 1e6::DOUBLE AS seconds FROM u"),
    "device_union": (lambda s, d: (lambda u: u.where("signal = 'click'").select("device").union(u.where("signal = 'view'").select("device")).distinct())(updates(s, d)), f"WITH {U} SELECT device FROM u WHERE signal = 'click' UNION SELECT device FROM u WHERE signal = 'view'"),
    "hex_payload": (lambda s, d: frames(s, d).select("decoded_offset", F.lower(F.hex("payload")).alias("payload")), f"WITH {FR} SELECT decoded_offset, lower(hex(payload)) AS payload FROM fr"),
    "parquet_roundtrip": (_roundtrip, f"WITH {U} SELECT timestamp, {_cols} FROM u GROUP BY timestamp"),
}


def _unpivot_sql() -> str:
    rows = ", ".join(f"({GROUPS.index(d.group)}, '{d.group}', {d.spn}, '{d.column}', {d.shift}, {d.width})" for d in catalog.DEFINITIONS)
    raw = "(word >> shift) & ((1::BIGINT << width) - 1)"  # fields of 64 - shift bits would need an unsigned shift: words are not negative here
    return f"WITH {W} SELECT l_orderkey, l_linenumber, grp, spn::BIGINT AS spn, \"column\", {raw} AS raw FROM w JOIN (VALUES {rows}) AS t(n, grp, spn, \"column\", shift, width) ON n = (l_orderkey + l_linenumber) % {len(GROUPS)}"


def queries() -> dict:
    from driftframe.plans import logs

    return {n: q for n, (q, _) in QUERIES.items()} | logs.queries()


def oracle_sql() -> dict[str, str]:
    from driftframe.plans import logs

    return {n: sql for n, (_, sql) in QUERIES.items() if sql} | {"definition_unpivot": _unpivot_sql()} | logs.oracle_sql()

"""Every registered query outside the corpus operators against its SQL, and the log operators on a golden log."""

import os
import struct

import duckdb
import pytest

from driftframe import errors
from driftframe.operators import tables as tb
from driftframe.operators.logs import Log, open_log
from driftframe.plans import logs, registry
from driftframe.sources import siglog, wire
from driftframe.streaming.resequence import Buffer

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_golden_tables(spark):
    from test_wire import LOG

    log = Log(siglog.from_bytes(spark, LOG))
    assert [tuple(r) for r in log.wide().collect()] == [(937511, 1.0), (968018, 2.0)]
    assert [tuple(r) for r in log.narrow()["custom"].collect()] == [(937511, 32, 1.0), (968018, 50, 2.0)]
    report = log.report()
    assert (report["raw_frames"], report["custom_frames"], report["min_timestamp"], report["max_timestamp"], report["out_of_order_frames"], report["max_out_of_order_us"]) == (5, 4, 937511, 968018, 0, 0)
    assert [(u["arbitration_id"], u["record_class"], u["payload_len"], u["count"]) for u in report["unsupported"]] == [(0x0004F9BF, 3, 0, 1)]
    for bad in ([], ["missing"]):
        with pytest.raises(errors.SchemaError):
            log.wide(bad)


@pytest.mark.parametrize("keys", [30, 10_000])
def test_logs_hold_the_whole_table(spark, monkeypatch, keys):
    monkeypatch.setattr(logs, "KEYS", keys)
    d = "/root/testdata/sf0.01"
    want = sorted((r["s_suppkey"] * 1000, float(r["s_acctbal"])) for r in spark.read.parquet(f"{d}/supplier.parquet").collect())
    rows = [r for r in logs.log_frames(spark, d).collect() if r["header"] == 0xE0108001]
    got = sorted((r["timestamp_us"] // 1000 * 1000, struct.unpack("<d", bytes.fromhex(r["payload"]))[0]) for r in rows)
    assert len(want) == 100 and got == want
    assert {r["name"] for r in logs.log_signals(spark, d).collect()} == {"x"}


def make_log(*records):
    return wire.make_header() + wire.codebook().encode(b"".join(logs.record(*r) for r in records))


def test_several_logs(spark, tmp_path):
    """Two logs share x under different numbers; each has its own rows, also at equal times."""
    name, data = 0xE1101001, 0xE0108001
    one = struct.pack("<d", 1.0), struct.pack("<d", 2.0)
    a = make_log((name, 0, b"x"), (data, 10, one[0]), (data, 30, bytes(8)))
    b = make_log((name + 1, 0, b"x"), (0xE1041003, 0, b"y"), (data + 1, 10, one[1]), (data + 1, 20, bytes(8)))
    (tmp_path / "a").write_bytes(a)
    (tmp_path / "b").write_bytes(b)
    log = open_log(spark, str(tmp_path))
    rows = [(os.path.basename(r["path"]), r["timestamp"], r["x"]) for r in log.wide(["x"], with_path=True).collect()]
    assert rows == [("a", 11, 1.0), ("a", 31, 1.0), ("b", 11, 2.0), ("b", 21, 2.0)]
    assert [(r["timestamp"], r["x"]) for r in log.wide(["x"]).collect()] == [(11, 1.0), (11, 2.0), (21, 2.0), (31, 1.0)]
    assert log.narrow()["custom"].columns == ["timestamp", "source_sequence", "x", "y"] and log.check_order(0, 1) == 1
    got = []
    schema = log.batches(3, lambda t: got.append(t.num_rows), ["x"])
    assert got == [3, 1] and schema.names == ["timestamp", "x"]
    groups = []
    assert log.narrow_batches(3, lambda g, t: groups.append((g, t.num_rows))).names[:2] == ["timestamp", "source_sequence"] and groups == [("custom", 3), ("custom", 1)]
    with pytest.raises(errors.InvalidArgument):
        log.batches(0, print)

    def stop(batch):
        raise KeyError("enough")

    with pytest.raises(KeyError):
        log.batches(1, stop)
    assert [r["decoded_offset"] for r in log.updates(ordered=True).collect()] == sorted(r["decoded_offset"] for r in log.updates().where("path like '%a'").collect()) + sorted(r["decoded_offset"] for r in log.updates().where("path like '%b'").collect())
    (tmp_path / "c").write_bytes(make_log((0xE1141001, 0, b"x")))  # x as text
    with pytest.raises(errors.SchemaError):
        open_log(spark, str(tmp_path)).wide()
    log.close()


def test_scan_pushes_filters(spark, tmp_path):
    from test_wire import LOG

    (tmp_path / "a").write_bytes(LOG)
    (tmp_path / "b").write_bytes(LOG)
    assert siglog.scan(spark, str(tmp_path)).count() == 10
    assert siglog.scan(spark, str(tmp_path)).where("record_class = 3").select("decoded_offset").collect() == [(0,), (0,)]
    assert siglog.scan(spark, str(tmp_path / "a"), "header").first()["source"] == "Simulation"
    by_bytes = siglog.read_logs(spark, str(tmp_path / "a"))
    assert by_bytes.drop("path").collect() == siglog.scan(spark, str(tmp_path / "a")).drop("path").collect()


def test_names():
    with pytest.raises(errors.SchemaError):
        tb.check_names(["timestamp"])
    with pytest.raises(errors.SchemaError):
        tb.check_names(["a", "a"])
    assert tb.check_names(["b", "a"], ["a", "b"]) == ["b", "a"]


def test_resequencing():
    b, out = Buffer(100, 10), []
    for t, v, s in ((20, 3.0, 1), (10, 1.0, 2), (10, 2.0, 3)):
        out += b.accept(t, "x", v, s)
    assert out == [] and [r[0] for r in b.flush()] == [10, 20]
    b = Buffer(5, 10)
    assert [r[0] for t in (1, 4, 10) for r in b.accept(t, "x", 0.0, t)] == [1, 4]
    with pytest.raises(errors.LateTimestamp):
        b.accept(3, "x", 0.0, 9)
    with pytest.raises(errors.InvalidArgument):
        Buffer(-1, 1)
    with pytest.raises(errors.ReorderBufferLimit):
        b = Buffer(100, 1)
        b.accept(1, "x", 0.0, 1)
        b.accept(2, "x", 0.0, 2)

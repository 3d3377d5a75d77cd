"""The command line on the golden log, and the re-sequencer as a stream."""

import json

from driftframe import cli
from driftframe.streaming.resequence import resequenced


def test_cli(spark, tmp_path, capsys):
    from test_wire import LOG

    path, cut = tmp_path / "a.log", tmp_path / "cut.log"
    path.write_bytes(LOG)
    cut.write_bytes(LOG[:-3])
    assert cli.main(["convert", str(path), str(tmp_path / "out")]) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").collect()] == [(937511, 1.0), (968018, 2.0)]
    assert cli.main(["repair-tail", str(cut), str(tmp_path / "fixed.log")]) == 0
    assert cli.main(["repair-tail", str(cut), str(tmp_path / "fixed.log")]) == 1
    capsys.readouterr()
    assert cli.main(["info", str(path), "--json", "--semantic-stats"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["semantic_stats"] == {"updates": 2, "rows": 2, "signals": 1} and found["report"]["raw_frames"] == 5
    assert cli.main(["frames", str(path), "--arbitration-id", "0x01101001"]) == 0
    assert capsys.readouterr().out.split() == ["7", "78", "1", "1"]


def test_one_file_and_selection(spark, tmp_path, capsys):
    import pyarrow.parquet as pq
    from test_wire import LOG

    path, out = tmp_path / "a.log", tmp_path / "out.parquet"
    path.write_bytes(LOG)
    assert cli.main(["convert", str(path), str(out), "--rows-per-batch", "1", "--signals", "x"]) == 0
    found = pq.ParquetFile(out)
    assert found.num_row_groups == 2 and found.read().to_pylist() == [{"timestamp": 937511, "x": 1.0}, {"timestamp": 968018, "x": 2.0}]
    assert cli.main(["convert", str(path), str(out), "--rows-per-batch", "0"]) == 1
    assert cli.main(["convert", str(path), str(out), "--signals", "missing"]) == 1
    assert pq.ParquetFile(out).num_row_groups == 2 and [p.name for p in tmp_path.iterdir() if "tmp" in p.name] == []
    capsys.readouterr()
    assert cli.main(["info", str(path)]) == 0
    assert "physical frames: 5" in capsys.readouterr().out
    assert cli.main(["schema", str(path)]) == 0
    assert json.loads(capsys.readouterr().out)["signals"][0]["bus"] == "Simulation"


def test_a_bad_descriptor_is_named(spark, tmp_path, capsys):
    from driftframe.plans.logs import record
    from driftframe.sources import wire

    path = tmp_path / "bad.log"
    path.write_bytes(wire.make_header() + wire.codebook().encode(record(0xE1000101, 0, b"x")))
    assert cli.main(["convert", str(path), str(tmp_path / "out")]) == 1
    assert "InvalidCustomDescriptor" in capsys.readouterr().err and not (tmp_path / "out").exists()
    path.write_bytes(wire.make_header() + wire.codebook().encode(record(0xE0108001, 5, bytes(8))))
    assert cli.main(["convert", str(path), str(tmp_path / "out")]) == 1
    assert "MissingSignalDefinition" in capsys.readouterr().err


def test_values_of_other_types_pass_the_stream(spark, tmp_path):
    schema, src = "path string, timestamp long, signal string, value array<string>, seq long", str(tmp_path / "in")
    spark.createDataFrame([("l", 2, "s", ["a", "b"], 1), ("l", 1, "s", None, 2), ("l", None, None, None, 3)], schema).coalesce(1).write.parquet(src)
    found = resequenced(spark.readStream.schema(schema).parquet(src), 0, regression=5)
    q = found.writeStream.format("memory").queryName("texts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r["timestamp"], r["signals"]) for r in spark.sql("select * from texts").collect()] == [(1, '{"s": null}'), (2, '{"s": ["a", "b"]}')]


def test_stream(spark, tmp_path):
    schema = "path string, timestamp long, signal string, value double, seq long"
    src = str(tmp_path / "in")
    rows = [("l", 300, "x", 1.0, 10), ("l", 500, "x", 2.0, 20), ("l", 100, "x", 3.0, 30), ("l", None, None, None, 40)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = resequenced(spark.readStream.schema(schema).parquet(src), 400).writeStream.format("memory").queryName("resequenced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r["timestamp"], r["source_sequence"]) for r in spark.sql("select * from resequenced").collect()] == [(100, 30), (300, 10), (500, 20)]

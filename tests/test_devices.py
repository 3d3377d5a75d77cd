"""Device records of the fixed catalog, on golden payloads."""

import pytest

from driftframe.functions import catalog
from driftframe.operators.logs import Log
from driftframe.sources.siglog import FRAMES


def frame(i, base, device, cls, hexed, ts=None):
    a, p = base | device, bytearray.fromhex(hexed)
    return ("log", i * 10, 80 + i, 0, cls << 29 | a, a, cls, ts or i * 1000, ts or i * 1000, len(p), 0, p, p)


def log(spark, rows):
    return Log(spark.createDataFrame(rows, FRAMES))


G = {g: v[0] for g, v in catalog.GROUPS.items()}


def test_classic_device(spark):
    rows = [
        frame(1, G["VERSION"], 5, 1, "0000021a1380"), frame(2, G["MOTOR_OUTPUT"], 5, 1, "080580ef1c71b10d"), frame(3, G["SUPPLY_TEMP"], 5, 1, "120ae4014c191f1c"),
        frame(4, G["MOTION"], 5, 1, "240080d4ffffff3f"), frame(5, G["MOTOR_OUTPUT"], 6, 1, "080580ef1c71b10d"),
    ]
    made = log(spark, rows)
    assert {(r["device_id"], r["transport"], r["firmware_major"], r["is_pro_licensed"], r["catalog_supported"]) for r in made.devices.collect()} == {(5, "can2", 26, True, True), (6, "can2", None, False, False)}
    got = {r["name"]: r["float64"] if r["float64"] is not None else r["string"] if r["string"] is not None else r["int64"] for r in made.updates().collect() if r["decoded_offset"] != 10 or "version" in r["name"] or "reset" in r["name"]}
    want = {
        "motor_voltage": 3.22, "duty_cycle": 0.27734375, "torque_current": 3505 * 0.01, "stator_current": 51.56, "supply_current": 19.36, "supply_voltage": 304 * 0.025 + 4, "device_temp": 25.0, "processor_temp": 31.0,
        "ancillary_device_temp": 28.0, "velocity": 0.017578125, "acceleration": -0.25, "version_major": 26.0, "version_minor": 2.0, "version": 436338688.0,
    }
    assert {n: got[f"device_5_{n}"] for n in want} == pytest.approx(want)
    assert got["device_5_bridge_output"] == "BridgeReq_FOCTorque" and got["device_5_reset_count"] == 0 and not [n for n in got if n.startswith("device_6")]
    wide = made.wide(["device_5_motor_voltage", "device_5_bridge_output", "device_5_timestamp"]).collect()
    assert [(r[0], r["device_5_bridge_output"]) for r in wide] == [(1000, None), (2000, "BridgeReq_FOCTorque"), (3000, None), (4000, None)]
    assert [u["arbitration_id"] for u in made.unsupported().collect()] == [G["MOTOR_OUTPUT"] | 6]
    names = [r["name"] for r in made.signals().collect()]
    assert names.index("device_5_version_major") < names.index("device_5_motor_voltage") < names.index("device_5_timestamp")


def test_fd_device_reuses_the_last_class_3_word(spark):
    rows = [
        frame(1, G["VERSION"], 9, 3, "0000021a1380"), frame(2, catalog.BUNDLE_BASE, 9, 3, "080580ef1c71b10d" + "00" * 56), frame(3, G["FAULTS"], 9, 3, "0000000000038002"),
        frame(4, G["FAULTS"], 9, 1, "0000000000000000"),
    ]
    made = log(spark, rows)
    assert [(r["device_id"], r["transport"], r["catalog_supported"]) for r in made.devices.collect()] == [(9, "can_fd", True)]
    sticky = {r["decoded_offset"]: r["float64"] for r in made.updates().where("name = 'device_9_sticky_fault_field'").collect()}
    assert sticky == {30: float(0x02800300), 40: float(0x02800300)}
    assert made.updates().where("name = 'device_9_motor_voltage'").collect()[0]["float64"] == pytest.approx(3.22)


def test_float_fields(spark):
    import struct

    word = struct.unpack("<I", struct.pack("<f", 1.5))[0] | (struct.unpack("<I", struct.pack("<f", -2.25))[0] >> 1) << 32
    rows = [frame(1, G["VERSION"], 5, 1, "0000021a1380"), frame(2, G["PID_REF_ERROR"], 5, 1, struct.pack("<Q", word).hex())]
    got = {r["name"]: r["float64"] for r in log(spark, rows).updates().where("decoded_offset = 20").collect()}
    assert got["device_5_pid_position_reference"] == 1.5 and got["device_5_pid_position_closed_loop_error"] == -2.25

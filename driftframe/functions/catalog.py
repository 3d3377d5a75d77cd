"""The fixed catalog of one device family's frames, and how their fields read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import bits

FIRMWARE_MAJOR = 26
BUNDLE_BASE, BUNDLE_BYTES = 0x02042B40, 64

#: Fixed values of the format: base id, bytes and, in the bundle, byte offset of each group of fields.
GROUPS = {
    "MOTOR_OUTPUT": (0x02042c40, 8, 0),
    "SUPPLY_TEMP": (0x02042d40, 8, 8),
    "ROTOR": (0x02042d80, 8, 16),
    "MOTION": (0x02042dc0, 8, 24),
    "PID_STATE": (0x02042e00, 8, 32),
    "PID_REF_ERROR": (0x02042e40, 8, 40),
    "PID_OUTPUT": (0x02042e80, 8, 48),
    "PID_SLOPE": (0x02042ec0, 8, 56),
    "MOTOR_CONSTANTS": (0x02043040, 8, None),
    "FAULTS": (0x02044740, 8, None),
    "VERSION": (0x02046bc0, 6, None),
}

#: Fixed values of the format: number, column, kind (S signed, U unsigned, F float32, T text), shift, width, scale, bias,
#: units or the name of the texts. Faults stand below.
_FIELDS = {
    "MOTOR_OUTPUT": [
        (1772, "motor_voltage", "S", 2, 13, 0.01, 0.0, "V"),
        (1773, "forward_limit", "T", 0, 1, 1.0, 0.0, "limit"),
        (1774, "reverse_limit", "T", 1, 1, 1.0, 0.0, "limit"),
        (1775, "applied_rotor_polarity", "T", 31, 1, 1.0, 0.0, "polarity"),
        (1776, "duty_cycle", "S", 32, 12, 1.0 / 1024.0, 0.0, "fractional"),
        (1778, "torque_current", "S", 48, 16, 0.01, 0.0, "A"),
        (1963, "bridge_output", "T", 44, 4, 1.0, 0.0, "bridge"),
    ],
    "SUPPLY_TEMP": [
        (1779, "stator_current", "S", 0, 15, 0.02, 0.0, "A"),
        (1780, "supply_current", "S", 15, 15, 0.02, 0.0, "A"),
        (1781, "supply_voltage", "U", 30, 10, 0.025, 4.0, "V"),
        (1782, "device_temp", "U", 40, 8, 1.0, 0.0, "℃"),
        (1783, "processor_temp", "U", 48, 8, 1.0, 0.0, "℃"),
        (2091, "ancillary_device_temp", "U", 56, 8, 1.0, 0.0, "℃"),
    ],
    "ROTOR": [
        (1785, "rotor_velocity", "S", 2, 19, 1.0 / 512.0, 0.0, "rotations per second"),
        (1786, "rotor_position", "S", 21, 27, 1.0 / 4096.0, 0.0, "rotations"),
    ],
    "MOTION": [
        (1789, "velocity", "S", 2, 19, 1.0 / 512.0, 0.0, "rotations per second"),
        (1790, "position", "S", 21, 27, 1.0 / 4096.0, 0.0, "rotations"),
        (1791, "acceleration", "S", 48, 14, 0.25, 0.0, "rotations per second²"),
    ],
    "PID_STATE": [
        (1793, "pid_duty_cycle_integrated_accum", "S", 0, 18, 1.0 / 1024.0, 0.0, "fractional"),
        (1794, "pid_motor_voltage_integrated_accum", "S", 0, 18, 0.01, 0.0, "V"),
        (1795, "pid_torque_current_integrated_accum", "S", 0, 18, 0.1, 0.0, "A"),
        (1796, "pid_duty_cycle_feed_forward", "S", 18, 12, 1.0 / 1024.0, 0.0, "fractional"),
        (1797, "pid_motor_voltage_feed_forward", "S", 18, 12, 0.02, 0.0, "V"),
        (1798, "pid_torque_current_feed_forward", "S", 18, 12, 0.2, 0.0, "A"),
        (1799, "control_mode", "T", 30, 6, 1.0, 0.0, "control_mode"),
        (1805, "motion_magic_at_target", "U", 59, 1, 1.0, 0.0, ""),
        (1806, "motion_magic_is_running", "U", 60, 1, 1.0, 0.0, ""),
        (1807, "robot_enable", "T", 61, 1, 1.0, 0.0, "enable"),
        (1808, "device_enable", "T", 62, 1, 1.0, 0.0, "enable"),
    ],
    "PID_REF_ERROR": [
        (1810, "pid_position_reference", "F", 0, 32, 1.0, 0.0, "rotations"),
        (1811, "pid_velocity_reference", "F", 0, 32, 1.0, 0.0, "rotations per second"),
        (1812, "pid_position_closed_loop_error", "F", 32, 31, 1.0, 0.0, "rotations"),
        (1813, "pid_velocity_closed_loop_error", "F", 32, 31, 1.0, 0.0, "rotations per second"),
    ],
    "PID_OUTPUT": [
        (1817, "pid_duty_cycle_proportional_output", "S", 8, 18, 1.0 / 1024.0, 0.0, "fractional"),
        (1818, "pid_motor_voltage_proportional_output", "S", 8, 18, 0.01, 0.0, "V"),
        (1819, "pid_torque_current_proportional_output", "S", 8, 18, 0.1, 0.0, "A"),
        (1820, "pid_duty_cycle_derivative_output", "S", 26, 18, 1.0 / 1024.0, 0.0, "fractional"),
        (1821, "pid_motor_voltage_derivative_output", "S", 26, 18, 0.01, 0.0, "V"),
        (1822, "pid_torque_current_derivative_output", "S", 26, 18, 0.1, 0.0, "A"),
        (1823, "pid_duty_cycle_output", "S", 44, 18, 1.0 / 1024.0, 0.0, "fractional"),
        (1824, "pid_motor_voltage_output", "S", 44, 18, 0.01, 0.0, "V"),
        (1825, "pid_torque_current_output", "S", 44, 18, 0.1, 0.0, "A"),
        (1826, "closed_loop_slot", "U", 62, 2, 1.0, 0.0, ""),
        (2117, "connected_motor", "T", 2, 4, 1.0, 0.0, "motor"),
    ],
    "PID_SLOPE": [
        (1827, "pid_position_reference_slope", "S", 0, 16, 1.0 / 64.0, 0.0, "rotations per second"),
        (1828, "pid_velocity_reference_slope", "S", 0, 16, 1.0 / 64.0, 0.0, "rotations per second²"),
        (1830, "motor_output_status", "T", 17, 3, 1.0, 0.0, "motor_status"),
    ],
    "MOTOR_CONSTANTS": [
        (1874, "motor_kt", "U", 2, 8, 0.0001, 0.0, "Nm/A"),
        (1875, "motor_kv", "U", 10, 11, 1.0, 0.0, "RPM/V"),
        (1876, "motor_stall_current", "U", 21, 10, 1.0, 0.0, "A"),
    ],
    "FAULTS": [
        (844, "fault_field", "U", 0, 32, 1.0, 0.0, ""),
        (845, "sticky_fault_field", "U", 32, 32, 1.0, 0.0, ""),
    ],
    "VERSION": [
        (734, "version_major", "U", 24, 8, 1.0, 0.0, ""),
        (735, "version_minor", "U", 16, 8, 1.0, 0.0, ""),
        (736, "version_bugfix", "U", 8, 8, 1.0, 0.0, ""),
        (737, "version_build", "U", 0, 8, 1.0, 0.0, ""),
        (738, "version", "U", 0, 32, 1.0, 0.0, ""),
        (2052, "is_pro_licensed", "U", 47, 1, 1.0, 0.0, ""),
    ],
}

#: Fixed values of the format: number, column and bit of each fault.
_FAULTS = [
    (10001, "fault_hardware", 0),
    (10002, "sticky_fault_hardware", 32),
    (10004, "fault_proc_temp", 1),
    (10005, "sticky_fault_proc_temp", 33),
    (10007, "fault_device_temp", 2),
    (10008, "sticky_fault_device_temp", 34),
    (10010, "fault_undervoltage", 3),
    (10011, "sticky_fault_undervoltage", 35),
    (10013, "fault_boot_during_enable", 4),
    (10014, "sticky_fault_boot_during_enable", 36),
    (10016, "fault_unlicensed_feature_in_use", 5),
    (10017, "sticky_fault_unlicensed_feature_in_use", 37),
    (10049, "fault_bridge_brownout", 23),
    (10050, "sticky_fault_bridge_brownout", 55),
    (10052, "fault_remote_sensor_reset", 22),
    (10053, "sticky_fault_remote_sensor_reset", 54),
    (10055, "fault_missing_differential_fx", 21),
    (10056, "sticky_fault_missing_differential_fx", 53),
    (10058, "fault_remote_sensor_pos_overflow", 20),
    (10059, "sticky_fault_remote_sensor_pos_overflow", 52),
    (10061, "fault_over_supply_v", 19),
    (10062, "sticky_fault_over_supply_v", 51),
    (10064, "fault_unstable_supply_v", 18),
    (10065, "sticky_fault_unstable_supply_v", 50),
    (10067, "fault_reverse_hard_limit", 17),
    (10068, "sticky_fault_reverse_hard_limit", 49),
    (10070, "fault_forward_hard_limit", 16),
    (10071, "sticky_fault_forward_hard_limit", 48),
    (10073, "fault_reverse_soft_limit", 15),
    (10074, "sticky_fault_reverse_soft_limit", 47),
    (10076, "fault_forward_soft_limit", 14),
    (10077, "sticky_fault_forward_soft_limit", 46),
    (10079, "fault_missing_soft_limit_remote", 13),
    (10080, "sticky_fault_missing_soft_limit_remote", 45),
    (10082, "fault_missing_hard_limit_remote", 12),
    (10083, "sticky_fault_missing_hard_limit_remote", 44),
    (10085, "fault_remote_sensor_data_invalid", 11),
    (10086, "sticky_fault_remote_sensor_data_invalid", 43),
    (10088, "fault_fused_sensor_out_of_sync", 10),
    (10089, "sticky_fault_fused_sensor_out_of_sync", 42),
    (10091, "fault_stator_curr_limit", 9),
    (10092, "sticky_fault_stator_curr_limit", 41),
    (10094, "fault_supply_curr_limit", 8),
    (10095, "sticky_fault_supply_curr_limit", 40),
    (10097, "fault_using_fused_ca_ncoder_while_unlicensed", 7),
    (10098, "sticky_fault_using_fused_ca_ncoder_while_unlicensed", 39),
    (10100, "fault_static_brake_disabled", 6),
    (10101, "sticky_fault_static_brake_disabled", 38),
    (10145, "fault_rotor_fault1", 25),
    (10146, "sticky_fault_rotor_fault1", 57),
    (10148, "fault_rotor_fault2", 26),
    (10149, "sticky_fault_rotor_fault2", 58),
]


#: Fixed values of the format: texts of codes, and the text of all other codes.
ENUMS = {
    "limit": ({0: "Open", 1: "ClosedToGround"}, "Open"),
    "polarity": ({1: "PositiveIsClockwise"}, "PositiveIsCounterClockwise"),
    "enable": ({0: "Disabled", 1: "Enabled"}, "Disabled"),
    "bridge": (
        {0: "BridgeReq_Coast", 1: "BridgeReq_Brake", 6: "BridgeReq_Trapez", 7: "BridgeReq_FOCTorque", 8: "BridgeReq_MusicTone", 9: "BridgeReq_FOCEasy",
         12: "BridgeReq_FaultBrake", 13: "BridgeReq_FaultCoast", 14: "BridgeReq_ActiveBrake", 15: "BridgeReq_VariableBrake"},
        "BridgeReq_Coast",
    ),
    "control_mode": (
        {
            0: "DisabledOutput",
            1: "NeutralOut",
            2: "StaticBrake",
            3: "DutyCycleOut",
            4: "PositionDutyCycle",
            5: "VelocityDutyCycle",
            6: "MotionMagicDutyCycle",
            7: "DutyCycleFOC",
            8: "PositionDutyCycleFOC",
            9: "VelocityDutyCycleFOC",
            10: "MotionMagicDutyCycleFOC",
            11: "VoltageOut",
            12: "PositionVoltage",
            13: "VelocityVoltage",
            14: "MotionMagicVoltage",
            15: "VoltageFOC",
            16: "PositionVoltageFOC",
            17: "VelocityVoltageFOC",
            18: "MotionMagicVoltageFOC",
            19: "TorqueCurrentFOC",
            20: "PositionTorqueCurrentFOC",
            21: "VelocityTorqueCurrentFOC",
            22: "MotionMagicTorqueCurrentFOC",
            23: "Follower",
            24: "Reserved",
            25: "CoastOut",
            26: "UnauthorizedDevice",
            27: "MusicTone",
            28: "MotionMagicVelocityDutyCycle",
            29: "MotionMagicVelocityDutyCycleFOC",
            30: "MotionMagicVelocityVoltage",
            31: "MotionMagicVelocityVoltageFOC",
            32: "MotionMagicVelocityTorqueCurrentFOC",
            33: "MotionMagicExpoDutyCycle",
            34: "MotionMagicExpoDutyCycleFOC",
            35: "MotionMagicExpoVoltage",
            36: "MotionMagicExpoVoltageFOC",
            37: "MotionMagicExpoTorqueCurrentFOC",
        },
        "DisabledOutput",
    ),
    "motor": (
        {
            0: "Unknown",
            1: "Falcon500_Integrated",
            2: "KrakenX60_Integrated",
            3: "KrakenX44_Integrated",
            4: "Minion_JST",
            5: "Brushed_AB",
            6: "Brushed_AC",
            7: "Brushed_BC",
            8: "NEO_JST",
            9: "NEO550_JST",
            10: "VORTEX_JST",
            11: "CustomBrushless",
        },
        "Unknown",
    ),
    "motor_status": (
        {
            0: "Unknown",
            1: "Off",
            2: "StaticBraking",
            3: "Motoring",
            4: "DiscordantMotoring",
            5: "RegenBraking",
        },
        "Unknown",
    ),
}


class Definition(NamedTuple):
    group: str
    spn: int
    column: str
    kind: str
    shift: int
    width: int
    scale: float
    bias: float
    units: str | None
    texts: str | None


def _definitions() -> list[Definition]:
    out = []
    for group, fields in _FIELDS.items():
        for spn, column, kind, shift, width, scale, bias, units in fields:
            out.append(Definition(group, spn, column, kind, shift, width, scale, bias, None if kind == "T" else units or None, units if kind == "T" else None))
    for spn, column, bit in _FAULTS:
        out.append(Definition("FAULTS", spn, column, "U", bit, 1, 1.0, 0.0, None, None))
    return out


DEFINITIONS = _definitions()
#: Base ids whose records report a device's state in 8 bytes; the first eight also make up the bundle.
STATUS_BASES = {base: g for g, (base, size, _) in GROUPS.items() if size == 8}
BUNDLED = {base: offset for base, size, offset in GROUPS.values() if offset is not None}
VERSION_BASE = GROUPS["VERSION"][0]


def definitions(spark: SparkSession) -> DataFrame:
    """One row for each field: a fixed 110 rows, small enough to broadcast."""
    return spark.createDataFrame([tuple(d) for d in DEFINITIONS], "grp string, spn long, column string, kind string, shift int, width int, scale double, bias double, units string, texts string")


def enum_text(name: str, code: Column) -> Column:
    texts, default = ENUMS[name]
    out = None
    for k, v in texts.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(default)


def is_candidate(arbitration: Column, record_class: Column, length: Column) -> Column:
    """Whether a record may update a device's signals."""
    base = bits.base_id(arbitration)
    known = (length == 6) & (base == VERSION_BASE) | (length == 8) & base.isin(list(STATUS_BASES)) | (length == 64) & (record_class == 3) & (base == BUNDLE_BASE)
    return record_class.isin(1, 3) & known

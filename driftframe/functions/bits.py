"""Bit fields of 64-bit words and record headers, as column expressions; words are longs of which all 64 bits count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract(word: Column | str, shift: int, width: int) -> Column:
    """width bits from bit shift up, unsigned; a width of 64 is the word itself."""
    word = F.shiftrightunsigned(_c(word), shift)
    return word if width >= 64 else word.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def sign_extend(value: Column | str, width: int) -> Column:
    return F.shiftright(F.shiftleft(_c(value), 64 - width), 64 - width)


def scaled(raw: Column, scale: float, bias: float = 0.0) -> Column:
    out = raw.cast("double") * F.lit(float(scale))
    return out + F.lit(float(bias)) if bias else out


def float_from_bits(bits: Column | str) -> Column:
    """The double that a float32 of these 32 bits is."""
    b = _c(bits)
    sign = F.when(extract(b, 31, 1) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = extract(b, 23, 8), extract(b, 0, 23)
    normal = sign * (F.lit(1.0) + fraction / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), exponent.cast("double") - 127)
    small = sign * fraction.cast("double") * F.pow(F.lit(2.0), F.lit(-149.0))
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal)


def word_le(payload: Column | str, size: int = 8) -> Column:
    """The first size bytes of a binary, little end first, as one word."""
    out = F.lit(0).cast("long")
    for i in range(size):
        byte = F.conv(F.hex(F.substring(_c(payload), i + 1, 1)), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return out


def dlc_length(dlc: Column | str) -> Column:
    """Payload bytes of a length code of 4 bits."""
    return F.element_at(F.array(*(F.lit(n) for n in DLC_LENGTHS)), (_c(dlc) + 1).cast("int"))


#: Fixed values of the format.
DLC_LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)
ARBITRATION_MASK = 0x1FFFFFFF
CUSTOM_CLASS = 7


def arbitration_id(header: Column | str) -> Column:
    return _c(header).bitwiseAND(F.lit(ARBITRATION_MASK).cast("long"))


def record_class(header: Column | str) -> Column:
    return extract(header, 29, 3).cast("int")


def device_id(arbitration: Column | str) -> Column:
    return _c(arbitration).bitwiseAND(F.lit(0x3F).cast("long")).cast("int")


def base_id(arbitration: Column | str) -> Column:
    return _c(arbitration).bitwiseAND(F.lit(~0x3F).cast("long"))


def custom_fields(header: Column | str) -> dict[str, Column]:
    """Fields of a custom record's header: index, descriptor_ok, type_code, exact_length, subtype."""
    h = _c(header)
    descriptor = extract(h, 8, 16)
    combined = F.shiftrightunsigned(descriptor, 4)
    return {
        "signal_index": extract(h, 0, 8),
        "descriptor_ok": (descriptor.bitwiseAND(F.lit(15).cast("long")) == 0) & (extract(h, 0, 8) != 0),
        "type_code": F.floor(combined / 64) * 4,
        "exact_length": combined % 64,
        "subtype": extract(h, 24, 5),
    }


def custom_raw_id(index: Column | str) -> Column:
    return F.shiftleft(_c(index).cast("long"), 16).bitwiseOR(F.lit(0xFF00).cast("long"))


def catalog_raw_id(spn: Column | str, device: Column | str) -> Column:
    return F.shiftleft(_c(spn).cast("long"), 16).bitwiseOR(F.shiftleft(_c(device).cast("long"), 8))


def timestamp_raw_id(device: Column | str) -> Column:
    return F.lit(0xFE000000).cast("long").bitwiseOR(F.shiftleft(_c(device).cast("long"), 8))


def reset_raw_id(device: Column | str) -> Column:
    return F.lit(0xFE000001).cast("long").bitwiseOR(F.shiftleft(_c(device).cast("long"), 8))


def firmware_parts(version: Column | str) -> dict[str, Column]:
    return {n: extract(version, s, 8) for n, s in (("major", 24), ("minor", 16), ("bugfix", 8), ("build", 0))}


def seconds(micros: Column | str) -> Column:
    return _c(micros).cast("double") / F.lit(1e6)


def units_metadata(units: Column | str) -> Column:
    """{"units": "..."} with the unit escaped, or {} for null."""
    quoted = F.to_json(F.struct(_c(units).alias("units")))
    return F.when(_c(units).isNull(), F.lit("{}")).otherwise(F.regexp_replace(quoted, r'^\{"units":', '{"units": '))


def snake_name(name: Column | str) -> Column:
    """A leaf name in lower case with words divided by _."""
    out = F.regexp_replace(_c(name), r"[^A-Za-z0-9]+", "_")
    out = F.regexp_replace(out, r"([a-z0-9])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, r"([A-Z])([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(out, "^_+|_+$", ""), "_+", "_"))

"""Errors, each with the fields that say where and why."""

from __future__ import annotations

import re


class TelemetryError(Exception):
    """Base of all errors of this package; keyword arguments become attributes."""

    def __init__(self, message: str = "", **fields):
        super().__init__(message or ", ".join(f"{k}={v}" for k, v in fields.items()) or type(self).__name__)
        self.__dict__.update(fields)

    def __reduce__(self):  # so that workers can send it
        return _again, (type(self), str(self), dict(self.__dict__))


def _again(kind, message, fields):
    return kind(message, **fields)


class TruncatedHeader(TelemetryError): ...


class InvalidHeaderText(TelemetryError): ...


class UnsupportedCompliancy(TelemetryError): ...


class UnsupportedFormatFlags(TelemetryError): ...


class InvalidPrefixCode(TelemetryError): ...


class MissingEndMarker(TelemetryError): ...


class TruncatedRecord(TelemetryError): ...


class DecodedSizeLimit(TelemetryError): ...


class PayloadStateLimit(TelemetryError): ...


class InvalidCustomDescriptor(TelemetryError): ...


class UnsupportedCustomType(TelemetryError): ...


class InvalidCustomPayload(TelemetryError): ...


class MissingSignalDefinition(TelemetryError): ...


class LateTimestamp(TelemetryError): ...


class ReorderBufferLimit(TelemetryError): ...


class SchemaError(TelemetryError): ...


class InvalidArgument(TelemetryError): ...


def typed(e: Exception) -> Exception:
    """The error of this package that a failed task's text tells of, else e itself."""
    if isinstance(e, TelemetryError):
        return e
    kinds = {c.__name__: c for c in TelemetryError.__subclasses__()}
    found = re.search(rf"\b({'|'.join(kinds)}): ([^\n]*)", str(e))
    return kinds[found[1]](found[2].strip().rstrip("'\"")) if found else e

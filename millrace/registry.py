"""The closed set of operators: role, settings and how many rows each makes of one."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from millrace.errors import InvalidTopology, LimitExceeded
from millrace.limits import DEFAULT, INT64, Limits

ROLES = ("source", "transform", "sink")


@dataclass(frozen=True)
class Operator:
    name: str
    role: str
    settings: tuple[tuple[str, str], ...]  # (key, "int64" or "string"), by key
    outputs: int  # of one input row, at most
    reads: str | None  # the one field that its input must have; None: any, or no input
    makes: str | None  # the field of its output; None: that of its input
    version: int = 1


REGISTRY = {
    op.name: op
    for op in (
        Operator("collect", "sink", (), 0, None, None),
        Operator("even", "transform", (), 1, "value", "value"),
        Operator("less_than", "transform", (("threshold", "int64"),), 1, "value", "value"),
        Operator("lines", "source", (("corpus", "string"),), 1, None, "line"),
        Operator("min_length", "transform", (("length", "int64"),), 1, "word", "word"),
        Operator("multiply", "transform", (("factor", "int64"),), 1, "value", "value"),
        Operator("range", "source", (("end_exclusive", "int64"), ("start", "int64")), 1, None, "value"),
        Operator("split_words", "transform", (), 16, "line", "word"),
    )
}


def fingerprint() -> bytes:
    """Names this registry; part of every topology's digest."""
    return hashlib.sha256(repr(sorted(REGISTRY.items())).encode()).digest()


def check_name(value: str, what: str, most: int) -> None:
    if not value or len(value.encode()) > most:
        raise LimitExceeded(f"{what}: length is outside 1..{most} bytes")
    if any(not " " <= c <= "~" for c in value):
        raise InvalidTopology(f"{what}: only printable ASCII is allowed")


def parse_int64(text: str) -> int:
    """Only the canonical decimal spelling."""
    try:
        value = int(text)
    except ValueError:
        raise InvalidTopology(f"{text!r} is not an int64") from None
    if str(value) != text or not INT64[0] <= value <= INT64[1]:
        raise InvalidTopology(f"{text!r} is not a canonical int64")
    return value


def lookup(name: str, version: int, settings: tuple[tuple[str, str], ...], limits: Limits = DEFAULT) -> tuple[Operator, dict[str, int | str]]:
    """The operator, and its settings' values."""
    check_name(name, "operator name", limits.identifier_bytes)
    if len(settings) > limits.settings_per_stage:
        raise LimitExceeded("too many settings")
    for key, value in settings:
        check_name(key, "setting key", limits.setting_key_bytes)
        if len(value.encode()) > limits.setting_value_bytes:
            raise LimitExceeded(f"the value of setting {key!r} is too long")
    keys = [key for key, _ in settings]
    if keys != sorted(set(keys), key=str.encode):
        raise InvalidTopology("settings are not sorted and unique")
    op = REGISTRY.get(name)
    if op is None or op.version != version:
        raise InvalidTopology(f"unknown operator {name!r} version {version}")
    if keys != [key for key, _ in op.settings]:
        raise InvalidTopology(f"operator {name!r} takes the settings {[key for key, _ in op.settings]}")
    values: dict[str, int | str] = {}
    for (key, text), (_, kind) in zip(settings, op.settings, strict=True):
        if kind == "string" and not text:
            raise InvalidTopology(f"setting {key!r} is empty")
        values[key] = parse_int64(text) if kind == "int64" else text
    return op, values

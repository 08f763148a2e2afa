"""Canonical bytes of a row: u16 number of fields, then by name u16 length and name, u8 tag, and the value (an int64, or
u16 length and bytes). Numbers are big-endian. A row has one form, so equal rows have equal bytes."""

from __future__ import annotations

import struct

from millrace.errors import InvalidTopology, LimitExceeded, MillraceError
from millrace.limits import DEFAULT, INT64, Limits

INT, TEXT, BYTES = 1, 2, 3
MOST_FIELDS = 64


class MalformedTuple(MillraceError):
    """The bytes are no canonical row."""


def encode(fields: dict[str, int | str | bytes], limits: Limits = DEFAULT) -> bytes:
    if len(fields) > MOST_FIELDS:
        raise LimitExceeded(f"a row has at most {MOST_FIELDS} fields")
    out = [struct.pack(">H", len(fields))]
    for name, value in sorted(fields.items(), key=lambda f: f[0].encode()):
        own = name.encode()
        if not 1 <= len(own) <= limits.identifier_bytes:
            raise LimitExceeded(f"a field's name has 1..{limits.identifier_bytes} bytes")
        out.append(struct.pack(">H", len(own)) + own)
        if isinstance(value, bool) or not isinstance(value, (int, str, bytes, bytearray)):
            raise InvalidTopology(f"field {name!r} is no int64, text or bytes")
        if isinstance(value, int):
            if not INT64[0] <= value <= INT64[1]:
                raise InvalidTopology(f"field {name!r} is outside int64")
            out.append(struct.pack(">Bq", INT, value))
            continue
        data = value.encode() if isinstance(value, str) else bytes(value)
        if len(data) > limits.tuple_bytes:
            raise LimitExceeded(f"a row has at most {limits.tuple_bytes} bytes")
        out.append(struct.pack(">BH", TEXT if isinstance(value, str) else BYTES, len(data)) + data)
    encoded = b"".join(out)
    if len(encoded) > limits.tuple_bytes:
        raise LimitExceeded(f"a row has at most {limits.tuple_bytes} bytes")
    return encoded


def decode(data: bytes, limits: Limits = DEFAULT) -> dict[str, int | str | bytes]:
    at, out = 0, {}

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise MalformedTuple("the bytes are cut short")
        at += n
        return data[at - n : at]

    try:
        for _ in range(struct.unpack(">H", take(2))[0]):
            name = take(struct.unpack(">H", take(2))[0]).decode()
            (tag,) = take(1)
            if tag == INT:
                out[name] = struct.unpack(">q", take(8))[0]
            elif tag in (TEXT, BYTES):
                value = take(struct.unpack(">H", take(2))[0])
                out[name] = value.decode() if tag == TEXT else value
            else:
                raise MalformedTuple(f"unknown tag {tag}")
    except UnicodeDecodeError:
        raise MalformedTuple("a text is no UTF-8") from None
    if encode(out, limits) != data:
        raise MalformedTuple("the bytes are not canonical")
    return out

"""Identifiers and byte encodings of scalars, keys and wire values."""

from __future__ import annotations

import datetime
import math
import os
import struct
import threading
import time
import zlib
from typing import Any

from ..errors import DocumentValidationError
from ..model import ID, KIND_BOOL, KIND_DOUBLE, KIND_INT, KIND_NULL, KIND_STRING, kind_of

_lock = threading.Lock()
_process = os.urandom(5)
_counter = int.from_bytes(os.urandom(3), "big")


def object_id() -> str:
    """24 hexadecimal digits: seconds, five random bytes of this process, a counter."""
    global _counter
    with _lock:
        _counter = (_counter + 1) % 2**24
        n = _counter
    return (struct.pack(">I", int(time.time()) % 2**32) + _process + n.to_bytes(3, "big")).hex()


def with_id(document: dict) -> dict:
    """The document with an identifier, made if it has none."""
    return document if ID in document else {ID: object_id(), **document}


def sortable_double(x: float) -> bytes:
    """Eight bytes whose order is the numbers' order."""
    bits = struct.unpack(">Q", struct.pack(">d", x))[0]
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))


def index_prefix(value: Any) -> bytes | None:
    """A scalar's part of an index key; None for arrays and objects, which are not indexed.

    Fixed values: 00 null, 01 false, 02 true, 03 and eight bytes a number, 04, length (little-endian) and UTF-8 a string.
    """
    kind = kind_of(value)
    if kind == KIND_NULL:
        return b"\x00"
    if kind == KIND_BOOL:
        return b"\x02" if value else b"\x01"
    if kind in (KIND_INT, KIND_DOUBLE):
        return b"\x03" + sortable_double(float(value))
    if kind == KIND_STRING:
        raw = value.encode()
        return b"\x04" + struct.pack("<I", len(raw)) + raw
    return None


def id_key(value: Any) -> bytes:
    """An identifier as a stored key: a one-field document in the public BSON layout."""
    kind = kind_of(value)
    codes = {KIND_DOUBLE: 0x01, KIND_STRING: 0x02, KIND_BOOL: 0x08, KIND_NULL: 0x0A, KIND_INT: 0x12}
    if kind not in codes:
        raise DocumentValidationError("_id must be a scalar")
    raw = value.encode() if kind == KIND_STRING else b""
    body = {KIND_NULL: lambda: b"", KIND_BOOL: lambda: bytes([value]), KIND_INT: lambda: struct.pack("<q", value), KIND_DOUBLE: lambda: struct.pack("<d", value), KIND_STRING: lambda: struct.pack("<i", len(raw) + 1) + raw + b"\x00"}[kind]()
    inner = bytes([codes[kind]]) + b"_id\x00" + body + b"\x00"
    return struct.pack("<i", len(inner) + 4) + inner


def id_of(key: bytes) -> Any:
    """The identifier in a stored key."""
    code, body = key[4], key[9:-1]
    readers = {0x01: lambda: struct.unpack("<d", body)[0], 0x02: lambda: body[4:-1].decode(), 0x08: lambda: bool(body[0]), 0x0A: lambda: None, 0x10: lambda: struct.unpack("<i", body)[0], 0x12: lambda: struct.unpack("<q", body)[0]}
    return readers[code]()


def index_key(value: Any, id_value: Any) -> bytes | None:
    """A composite index key: the scalar, then the identifier with its length."""
    prefix, own = index_prefix(value), id_key(id_value)
    return None if prefix is None else prefix + struct.pack("<I", len(own)) + own


def index_bounds(value: Any) -> tuple[bytes, bytes] | None:
    """The range of index keys of one scalar."""
    prefix = index_prefix(value)
    return None if prefix is None else (prefix + struct.pack("<I", 0), prefix + struct.pack("<I", 2**32 - 1))


def index_id(key: bytes) -> Any:
    """The identifier of a composite index key; None if the key is malformed."""
    sizes = {0: 1, 1: 1, 2: 1, 3: 9}
    if not key or key[0] > 4 or (key[0] == 4 and len(key) < 5):
        return None
    at = sizes[key[0]] if key[0] != 4 else 5 + struct.unpack("<I", key[1:5])[0]
    if len(key) < at + 4:
        return None
    n = struct.unpack("<I", key[at : at + 4])[0]
    return id_of(key[at + 4 : at + 4 + n]) if n and len(key) >= at + 4 + n else None


def checksum(data: bytes) -> int:
    return zlib.crc32(data)


class ObjectId(str):
    """An identifier that a client sent as such; it is stored as its text."""


def from_wire(value: Any) -> Any:
    """A client's value as stored: identifiers become text, what is not a number becomes 0, other kinds become null."""
    if isinstance(value, ObjectId):
        return str(value)
    if isinstance(value, dict):
        return {k: from_wire(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [from_wire(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return 0
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return None
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return None


def to_wire(value: Any) -> Any:
    """A stored value as a client sees it; values of other Spark types as text or number."""
    if isinstance(value, dict):
        return {k: to_wire(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_wire(v) for v in value]
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value

"""Canonical CBOR: shortest integers and floats, definite lengths, map keys by encoded length and then bytes."""

from __future__ import annotations

import math
import struct
from typing import Any


def _head(kind: int, n: int) -> bytes:
    for limit, code, form in ((24, None, ""), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
        if n < limit:
            return bytes([kind << 5 | (n if code is None else code)]) + (struct.pack(form, n) if form else b"")
    raise ValueError("integer out of range")


def encode(value: Any) -> bytes:
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        if math.isnan(value):
            return b"\xf9\x7e\x00"
        for code, form in ((0xF9, ">e"), (0xFA, ">f")):
            try:
                packed = struct.pack(form, value)
            except OverflowError:
                continue
            if struct.unpack(form, packed)[0] == value:
                return bytes([code]) + packed
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        items = sorted(((encode(k), encode(v)) for k, v in value.items()), key=lambda kv: (len(kv[0]), kv[0]))
        return _head(5, len(items)) + b"".join(k + v for k, v in items)
    raise TypeError(f"{type(value).__name__} has no canonical form")


def decode(data: bytes) -> Any:
    """The value; bytes left over, duplicate keys and any form that isn't canonical are errors."""
    value, end = _decode(data, 0)
    if end != len(data) or encode(value) != data:
        raise ValueError("not canonical")
    return value


def _decode(data: bytes, at: int) -> tuple[Any, int]:
    kind, info = data[at] >> 5, data[at] & 31
    at += 1
    if kind == 7:
        if info in (20, 21, 22):
            return {20: False, 21: True, 22: None}[info], at
        form = {25: ">e", 26: ">f", 27: ">d"}.get(info)
        if form is None:
            raise ValueError("unsupported simple value")
        size = struct.calcsize(form)
        return struct.unpack(form, data[at : at + size])[0], at + size
    if info < 24:
        n = info
    elif info < 28:
        size = 1 << (info - 24)
        n, at = int.from_bytes(data[at : at + size]), at + size
    else:
        raise ValueError("indefinite length")
    if kind == 0:
        return n, at
    if kind == 1:
        return -1 - n, at
    if kind in (2, 3):
        if at + n > len(data):
            raise ValueError("cut off")
        raw = data[at : at + n]
        return (raw if kind == 2 else raw.decode()), at + n
    if kind == 4:
        out = []
        for _ in range(n):
            v, at = _decode(data, at)
            out.append(v)
        return out, at
    if kind == 5:
        found: dict = {}
        for _ in range(n):
            k, at = _decode(data, at)
            v, at = _decode(data, at)
            if k in found:
                raise ValueError("duplicate key")
            found[k] = v
        return found, at
    raise ValueError("tags aren't supported")

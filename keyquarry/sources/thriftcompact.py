"""Structures of the Thrift compact protocol as plain Python values, enough to rewrite a Parquet footer.

A struct is a dict from field id to (type, value), in field order; lists and sets are (element type, values).
"""

from __future__ import annotations

# Type codes of the compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


def _read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def _read_value(data: bytes, at: int, kind: int):
    if kind in (I16, I32, I64):
        n, at = _read_uvarint(data, at)
        return (n >> 1) ^ -(n & 1), at
    if kind == BINARY:
        n, at = _read_uvarint(data, at)
        return data[at : at + n], at + n
    if kind == STRUCT:
        return _read_struct(data, at, 0)
    if kind in (TRUE, FALSE):  # within a list; in a struct the type is the value
        return data[at] == 1, at + 1
    if kind == BYTE:
        return data[at : at + 1], at + 1
    if kind == DOUBLE:
        return data[at : at + 8], at + 8
    if kind in (LIST, SET):
        head = data[at]
        at += 1
        n, element = head >> 4, head & 15
        if n == 15:
            n, at = _read_uvarint(data, at)
        items = []
        for _ in range(n):
            v, at = _read_value(data, at, element)
            items.append(v)
        return (element, items), at
    if kind == MAP:
        n, at = _read_uvarint(data, at)
        if not n:
            return (0, 0, []), at
        kinds = data[at]
        at += 1
        items = []
        for _ in range(n):
            k, at = _read_value(data, at, kinds >> 4)
            v, at = _read_value(data, at, kinds & 15)
            items.append((k, v))
        return (kinds >> 4, kinds & 15, items), at
    raise ValueError(f"unknown type {kind} in a structure")


def _read_struct(data: bytes, at: int, last: int) -> tuple[dict, int]:
    out = {}
    while True:
        head = data[at]
        at += 1
        if head == 0:
            return out, at
        kind = head & 15
        if head >> 4:
            last += head >> 4
        else:
            n, at = _read_uvarint(data, at)
            last = (n >> 1) ^ -(n & 1)
        if BYTE < kind < DOUBLE:  # numbers, mostly of one byte
            n = data[at]
            if n < 0x80:
                at += 1
            else:
                n, at = _read_uvarint(data, at)
            out[last] = (kind, (n >> 1) ^ -(n & 1))
        elif kind <= FALSE:
            out[last] = (kind, kind == TRUE)
        else:
            v, at = _read_value(data, at, kind)
            out[last] = (kind, v)


def read_struct(data: bytes, at: int = 0, last: int = 0) -> tuple[dict, int]:
    """A structure's fields and where it ends; fields up to `last` lie before `at`."""
    try:
        out, end = _read_struct(data, at, last)
    except IndexError:
        raise ValueError("a structure ends early") from None
    if end > len(data):
        raise ValueError("a structure ends early")
    return out, end


def _uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varint(n: int) -> bytes:
    return _uvarint((n << 1) ^ (n >> 63))


def _value(kind: int, v) -> bytes:
    if kind in (TRUE, FALSE):
        return b"\x01" if v else b"\x02"
    if kind in (BYTE, DOUBLE):
        return v
    if kind in (I16, I32, I64):
        return _varint(v)
    if kind == BINARY:
        return _uvarint(len(v)) + v
    if kind in (LIST, SET):
        element, items = v
        head = bytes([len(items) << 4 | element]) if len(items) < 15 else bytes([0xF0 | element]) + _uvarint(len(items))
        return head + b"".join(_value(element, x) for x in items)
    if kind == MAP:
        k, w, items = v
        return _uvarint(len(items)) + (bytes([k << 4 | w]) if items else b"") + b"".join(_value(k, a) + _value(w, b) for a, b in items)
    if kind == STRUCT:
        return struct_bytes(v)
    raise ValueError(f"unknown type {kind}")


def struct_bytes(fields: dict) -> bytes:
    out, last = [], 0
    for fid, (kind, v) in sorted(fields.items()):
        if kind in (TRUE, FALSE):
            kind = TRUE if v else FALSE
        out.append(bytes([(fid - last) << 4 | kind]) if 0 < fid - last < 16 else bytes([kind]) + _varint(fid))
        if kind not in (TRUE, FALSE):
            out.append(_value(kind, v))
        last = fid
    return b"".join(out) + b"\x00"

"""Values that are stored as one packed blob: compressed strings, integer sets, listpacks and ziplists.

Elements come out as bytes (text, or whole numbers as decimal text) or, where a caller needs to tell them apart, as
bytes and int.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from .errors import CorruptData
from .names import MAX_ALLOCATION, MAX_INTSET, MAX_LZF_RATIO

#: What a float's text may be: no underscores or blanks, which Python's float() would accept.
FLOAT = re.compile(rb"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|infinity|nan)\Z", re.I)


def text_float(raw: bytes) -> float:
    if not FLOAT.match(raw):
        raise CorruptData(f"no number: {raw[:40]!r}")
    return float(raw)


def lzf_decompress(data: bytes, size: int) -> bytes:
    """Literal runs and back references; the result must have exactly the stated size."""
    if size > MAX_ALLOCATION or size > len(data) * MAX_LZF_RATIO:
        raise CorruptData(f"compressed string of {len(data)} bytes states {size} bytes")
    out = bytearray()
    at, end = 0, len(data)
    try:
        while at < end:
            control = data[at]
            at += 1
            if control < 32:
                run = control + 1
                if at + run > end:
                    raise CorruptData("compressed string: literal run past the end")
                out += data[at : at + run]
                at += run
            else:
                n = control >> 5
                if n == 7:
                    n += data[at]
                    at += 1
                back = ((control & 31) << 8 | data[at]) + 1
                at += 1
                n += 2
                start = len(out) - back
                if start < 0:
                    raise CorruptData("compressed string: reference before the beginning")
                if back >= n:
                    out += out[start : start + n]
                else:  # the copy overlaps itself: what is there repeats
                    piece = bytes(out[start:])
                    out += (piece * (n // back + 1))[:n]
            if len(out) > size:
                raise CorruptData("compressed string is longer than stated")
    except IndexError:
        raise CorruptData("compressed string ends early") from None
    if len(out) != size:
        raise CorruptData(f"compressed string has {len(out)} bytes, stated {size}")
    return bytes(out)


def intset(blob: bytes) -> list[bytes]:
    """Sorted whole numbers of one width, as decimal text."""
    if len(blob) < 8:
        raise CorruptData("integer set: header too short")
    width, n = struct.unpack_from("<II", blob)
    if width not in (2, 4, 8):
        raise CorruptData(f"integer set: width {width}")
    if n > MAX_INTSET:
        raise CorruptData(f"integer set: {n} elements")
    if len(blob) != 8 + width * n:
        raise CorruptData(f"integer set: {len(blob)} bytes for {n} elements of {width}")
    return [b"%d" % v for v in np.frombuffer(blob, dtype=f"<i{width}", offset=8).tolist()]


def _back_length(size: int) -> int:
    """Bytes that a listpack entry's length takes behind it."""
    return 1 if size <= 127 else 2 if size < 16383 else 3 if size < 2097151 else 4 if size < 268435455 else 5


#: Text of the numbers that one byte holds.
SMALL = tuple(b"%d" % n for n in range(128))
#: Sizes in bytes of a listpack's integers by encoding.
LISTPACK_INTS = {0xF1: 2, 0xF2: 3, 0xF3: 4, 0xF4: 8}


def _long_string(blob: bytes, at: int) -> tuple[bytes, int]:
    """(value, size) of a string of 64 bytes or more."""
    b = blob[at]
    if b < 0xF0:
        n, head = (b & 0x0F) << 8 | blob[at + 1], 2
    elif b == 0xF0:
        n, head = int.from_bytes(blob[at + 1 : at + 5], "little"), 5
    else:
        raise CorruptData(f"listpack: unknown encoding {b:#x}")
    return blob[at + head : at + head + n], head + n


def _check_back(blob: bytes, at: int, size: int) -> int:
    """The place behind an entry's length, which must be its size."""
    back = _back_length(size)
    if at + size + back > len(blob):
        raise CorruptData("listpack: entry past the end")
    stated = 0
    for i, c in enumerate(blob[at + size : at + size + back]):
        if back > 1 and bool(c & 0x80) != (i > 0):
            raise CorruptData("listpack: entry length behind an entry is damaged")
        stated = stated << 7 | (c & 0x7F if back > 1 else c)
    if stated != size:
        raise CorruptData("listpack: entry length behind an entry is wrong")
    return at + size + back


def listpack(blob: bytes, numbers: bool = False) -> list:
    """Elements of a listpack; with numbers, whole numbers stay int."""
    end = len(blob)
    if end < 7:
        raise CorruptData("listpack: too short")
    if int.from_bytes(blob[:4], "little") != end:
        raise CorruptData("listpack: total bytes differ from the blob's")
    out: list = []
    add, from_bytes = out.append, int.from_bytes
    at = 6
    try:
        while True:
            b = blob[at]
            if b < 0x80:  # a number of 7 bits
                if blob[at + 1] != 1:
                    raise CorruptData("listpack: entry length behind an entry is wrong")
                add(b if numbers else SMALL[b])
                at += 2
            elif b < 0xC0:  # a string of up to 63 bytes
                stop = at + 1 + (b & 0x3F)
                if blob[stop] != stop - at:
                    raise CorruptData("listpack: entry length behind an entry is wrong")
                add(blob[at + 1 : stop])
                at = stop + 1
            elif b < 0xE0 or 0xF0 < b < 0xF5:  # a number of 13 bits, or of whole bytes
                if b < 0xE0:
                    value = (b & 0x1F) << 8 | blob[at + 1]
                    if value >= 4096:
                        value -= 8192
                    stop = at + 2
                else:
                    stop = at + 1 + LISTPACK_INTS[b]
                    value = from_bytes(blob[at + 1 : stop], "little", signed=True)
                if blob[stop] != stop - at:
                    raise CorruptData("listpack: entry length behind an entry is wrong")
                add(value if numbers else b"%d" % value)
                at = stop + 1
            elif b == 0xFF:
                if at != end - 1:
                    raise CorruptData("listpack: bytes after the end mark")
                return out
            else:
                value, size = _long_string(blob, at)
                at = _check_back(blob, at, size)
                add(value)
    except IndexError:
        raise CorruptData("listpack: no end mark") from None


def ziplist(blob: bytes, numbers: bool = False) -> list:
    """Elements of a ziplist. What follows the end mark, the tail offset and the count aren't looked at."""
    end = len(blob)
    if end < 11:
        raise CorruptData("ziplist: too short")
    if int.from_bytes(blob[:4], "little") != end:
        raise CorruptData("ziplist: total bytes differ from the blob's")
    out: list = []
    at = 10
    try:
        while (previous := blob[at]) != 0xFF:
            at += 5 if previous == 0xFE else 1
            b = blob[at]
            if b < 0x40:  # a string of up to 63 bytes
                stop = at + 1 + b
                if stop > end:
                    raise CorruptData("ziplist: entry past the end")
                out.append(blob[at + 1 : stop])
                at = stop
                continue
            kind = b >> 6
            if kind < 3:
                if kind == 1:
                    n, head = (b & 0x3F) << 8 | blob[at + 1], 2
                elif b == 0x80:
                    n, head = int.from_bytes(blob[at + 1 : at + 5], "big"), 5
                else:
                    raise CorruptData(f"ziplist: unknown encoding {b:#x}")
                if at + head + n > end:
                    raise CorruptData("ziplist: entry past the end")
                out.append(blob[at + head : at + head + n])
                at += head + n
                continue
            size = {0xC0: 2, 0xD0: 4, 0xE0: 8, 0xF0: 3, 0xFE: 1}.get(b)
            if size:
                if at + 1 + size > end:
                    raise CorruptData("ziplist: entry past the end")
                value = int.from_bytes(blob[at + 1 : at + 1 + size], "little", signed=True)
                at += 1 + size
            elif 0xF1 <= b <= 0xFD:
                value = (b & 0x0F) - 1
                at += 1
            else:
                raise CorruptData(f"ziplist: unknown encoding {b:#x}")
            out.append(value if numbers else b"%d" % value)
    except IndexError:
        raise CorruptData("ziplist: no end mark") from None
    return out


def scored_pairs(elements: list) -> list[tuple[bytes, float]]:
    """(member, score) from alternating elements of a listpack or ziplist read with numbers."""
    if len(elements) % 2:
        raise CorruptData("sorted set: a member without score")
    members = [b"%d" % m if type(m) is int else m for m in elements[0::2]]
    scores = [float(s) if type(s) is int else text_float(s) for s in elements[1::2]]
    return list(zip(members, scores))


def field_pairs(elements: list[bytes]) -> list[tuple[bytes, bytes, None]]:
    """(field, value, no expiry) from alternating elements."""
    if len(elements) % 2:
        raise CorruptData("hash: a field without value")
    return [(f, v, None) for f, v in zip(elements[0::2], elements[1::2])]

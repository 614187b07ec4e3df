"""Append logs: listpacks of entries under a master id, then totals and consumer groups."""

from __future__ import annotations

import struct

from .errors import CorruptData
from .names import MAX_STREAM_ENTRIES, STREAM_1, STREAM_3
from .packed import listpack

DELETED, SAME_FIELDS = 1, 2
MAX_ID = 2**64 - 1


def _number(n) -> int:
    if type(n) is not int or n < 0:
        raise CorruptData(f"stream: expected a whole number of 0 or more, got {n!r:.40}")
    return n


def _text(v) -> bytes:
    return b"%d" % v if type(v) is int else v


def entries_of(master: bytes, blob: bytes, room: int = MAX_STREAM_ENTRIES) -> list[tuple[str, list[tuple[bytes, bytes]]]]:
    """(id, fields) of a listpack's entries that aren't deleted; at most room of them."""
    if len(master) != 16:
        raise CorruptData(f"stream: master id of {len(master)} bytes")
    ms, seq = struct.unpack(">QQ", master)
    items = listpack(blob, numbers=True)
    out = []
    try:
        live, dead, n_fields = map(_number, items[:3])
        at = 3 + n_fields
        if items[at] != 0 or type(items[at]) is not int:
            raise CorruptData("stream: no zero after the master fields")
        master_fields = [_text(f) for f in items[3:at]]
        at += 1
        for _ in range(live + dead):
            flags, d_ms, d_seq = _number(items[at]), _number(items[at + 1]), _number(items[at + 2])
            at += 3
            if ms + d_ms > MAX_ID or seq + d_seq > MAX_ID:
                raise CorruptData("stream: id past 64 bits")
            if flags & SAME_FIELDS:
                end = at + n_fields
                fields = list(zip(master_fields, map(_text, items[at:end])))
            else:
                at += 1
                end = at + 2 * _number(items[at - 1])
                fields = list(zip(map(_text, items[at:end:2]), map(_text, items[at + 1 : end : 2])))
            _number(items[end])  # elements of the entry, for walking backwards
            at = end + 1
            if not flags & DELETED:
                if len(out) >= room:
                    raise CorruptData(f"stream: more than {MAX_STREAM_ENTRIES} entries")
                out.append((f"{ms + d_ms}-{seq + d_seq}", fields))
    except (IndexError, ValueError):  # ValueError: fewer than three elements
        raise CorruptData("stream: its listpack ends within an entry") from None
    if at != len(items):
        raise CorruptData("stream: elements after the last entry")
    return out


def read_stream(source, code: int, skip: bool = False):
    """(length, last id, entries) from an input with length(), string() and take(). A damaged listpack is told of only
    when the whole value has been read, so that the input stands behind it."""
    entries: list = []
    wrong: CorruptData | None = None
    for _ in range(source.length()):
        master, blob = source.string(), source.string()
        if not wrong and not skip:
            try:
                entries += entries_of(master, blob, MAX_STREAM_ENTRIES - len(entries))
            except CorruptData as e:
                wrong = e
    length, last_ms, last_seq = source.length(), source.length(), source.length()
    if code != STREAM_1:
        for _ in range(5):  # first id, greatest deleted id, entries ever added
            source.length()
    for _ in range(source.length()):  # consumer groups stay behind
        source.string()
        source.length(), source.length()
        if code != STREAM_1:
            source.length()
        for _ in range(source.length()):
            source.take(24)
            source.length()
        for _ in range(source.length()):
            source.string()
            source.take(16 if code == STREAM_3 else 8)
            for _ in range(source.length()):
                source.take(16)
    if wrong:
        raise wrong
    if not skip and length != len(entries):
        raise CorruptData(f"stream: states {length} entries, has {len(entries)}")
    return length, f"{last_ms}-{last_seq}", entries

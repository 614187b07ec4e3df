"""Listpacks of many keys at once: all of them are walked in step, one element of each at a time, by numpy.

What a step meets that isn't plain (long strings, damage) is left to the reader of single listpacks, which decodes it or
tells what is wrong with it; so are the last few listpacks, for which steps don't pay.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .packed import listpack

#: Fewer listpacks than this are read one by one.
FEW = 48
#: Bytes of elements that are gathered at a time.
GATHER = 4 << 20


class Packed(NamedTuple):
    """A value that is still packed: its listpacks, whose elements follow each other."""

    nodes: list[bytes]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By an element's first byte: its size without the length behind it (0: not plain), and the kind of its number (0: a
    string, 1: 7 bits, 2: 13 bits, 3 to 6: 2, 3, 4 or 8 bytes)."""
    size, kind = np.zeros(256, np.int64), np.zeros(256, np.int8)
    size[:0x80], kind[:0x80] = 1, 1
    size[0x80:0xC0] = 1 + np.arange(64)
    size[0xC0:0xE0], kind[0xC0:0xE0] = 2, 2
    for k, n in enumerate((2, 3, 4, 8)):
        size[0xF1 + k], kind[0xF1 + k] = 1 + n, 3 + k
    return size, kind


SIZE, KIND = _tables()


def _number(buf: np.ndarray, at: np.ndarray, kind: int) -> np.ndarray:
    """The numbers of one kind that begin at `at`."""
    if kind == 1:
        return buf[at].astype(np.int64)
    if kind == 2:
        v = (buf[at].astype(np.int64) & 0x1F) << 8 | buf[at + 1]
        return np.where(v >= 4096, v - 8192, v)
    n = (2, 3, 4, 8)[kind - 3]
    v = np.zeros(len(at), np.uint64)
    for i in range(n):
        v |= buf[at + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    shift = 64 - 8 * n
    return (v << np.uint64(shift)).view(np.int64) >> shift


def listpacks(blobs: Sequence[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(elements of each listpack, all elements one after the other as bytes); numbers become decimal text."""
    n = len(blobs)
    sizes = np.fromiter(map(len, blobs), np.int64, n)
    base = np.concatenate([[0], np.cumsum(sizes)])
    whole = b"".join(blobs) + bytes(16)
    buf = np.frombuffer(whole, np.uint8)
    end = base[1:]
    counts = np.full(n, -1, np.int64)
    sound = sizes >= 7
    first = np.where(sound, base[:-1], 0)
    stated = sum(buf[first + i].astype(np.int64) << 8 * i for i in range(4))
    live = np.flatnonzero(sound & (stated == sizes))
    at = base[:-1] + 6
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live) >= FEW:
        a = at[live]
        b = buf[a]
        size = SIZE[b]
        stop = a + size
        ended = (b == 0xFF) & (a == end[live] - 1)
        counts[live[ended]] = len(steps)
        plain = (size > 0) & (stop < end[live])
        plain &= buf[np.where(plain, stop, 0)] == size
        live = live[plain]
        steps.append((live, a[plain]))
        at[live] = stop[plain] + 1
    slow = np.flatnonzero(counts < 0)
    singly = [listpack(blobs[i]) for i in slow.tolist()]
    counts[slow] = [len(x) for x in singly]
    place = np.concatenate([[0], np.cumsum(counts)])
    total = int(place[-1])
    starts = np.zeros(total, np.int64)
    fast = np.ones(n, bool)
    fast[slow] = False
    for k, (who, a) in enumerate(steps):
        who_fast = fast[who]
        starts[place[who[who_fast]] + k] = a[who_fast]
    of_fast = np.repeat(fast, counts)
    heads = buf[starts]
    kinds = np.where(of_fast, KIND[heads], -1)
    lengths = np.where(kinds == 0, SIZE[heads] - 1, 0)
    source, offset = [whole], len(whole)
    from_ = starts + 1
    numbers = np.flatnonzero(kinds > 0)
    if len(numbers):
        values = np.zeros(len(numbers), np.int64)
        for kind in range(1, 7):
            mine = kinds[numbers] == kind
            if mine.any():
                values[mine] = _number(buf, starts[numbers[mine]], kind)
        text = pa.array(values).cast(pa.string())
        ends = np.frombuffer(text.buffers()[1], np.int32, len(numbers) + 1).astype(np.int64)
        source.append(text.buffers()[2].to_pybytes() if text.buffers()[2] else b"")
        from_[numbers], lengths[numbers] = offset + ends[:-1], np.diff(ends)
        offset += len(source[-1])
    apart = np.flatnonzero(~of_fast)
    if len(apart):
        flat = [e for x in singly for e in x]
        many = np.fromiter(map(len, flat), np.int64, len(flat))
        source.append(b"".join(flat))
        from_[apart], lengths[apart] = offset + np.cumsum(many) - many, many
    out = np.concatenate([[0], np.cumsum(lengths)])
    if out[-1] >= 2**31:
        raise ValueError("a batch of more than 2 GiB of elements")
    pool, data, at_element = np.frombuffer(b"".join(source), np.uint8), np.empty(int(out[-1]), np.uint8), 0
    while at_element < total:  # an index takes eight times the bytes that it picks, so some at a time
        low = int(out[at_element])
        to = max(at_element + 1, int(np.searchsorted(out, low + GATHER, side="right")) - 1)
        many = lengths[at_element:to]
        data[low : int(out[to])] = pool[np.repeat(from_[at_element:to] - out[at_element:to] + low, many) + np.arange(int(out[to]) - low)]
        at_element = to
    return counts, pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(data)])

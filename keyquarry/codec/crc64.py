"""CRC-64 of whole blocks with numpy.

The start value is 0 and nothing is added at the end, so the code is linear: a block is cut into equal lanes that are
worked side by side, and lanes are joined pairwise by shifting the left one over the right one's length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the reflected polynomial.
POLYNOMIAL = 0x95AC9329AC4BC9B5
LANE = 256


def _table(bits: int) -> np.ndarray:
    t = np.arange(1 << bits, dtype=np.uint64)
    one, poly = np.uint64(1), np.uint64(POLYNOMIAL)
    for _ in range(bits):
        t = np.where(t & one, (t >> one) ^ poly, t >> one)
    return t


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _table(8), _table(16)


def _spread(images: np.ndarray) -> np.ndarray:
    """Tables [8][256] of a linear map given by the images of the 64 bits."""
    out = np.zeros((8, 256), dtype=np.uint64)
    for byte in range(8):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ images[8 * byte + bit]
    return out


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for byte in range(8):
        out ^= tables[byte][(values >> np.uint64(8 * byte)) & np.uint64(255)]
    return out


@lru_cache(64)
def _doubling(k: int) -> np.ndarray:
    """Tables of the shift over 2^k bytes."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    if k == 0:
        t8 = _tables()[0]
        return _spread(t8[bits & np.uint64(255)] ^ (bits >> np.uint64(8)))
    half = _doubling(k - 1)
    return _spread(_apply(half, _apply(half, bits)))


def shift(crc: int, n: int) -> int:
    """The code of what has code crc, followed by n zero bytes."""
    v = np.array([crc], dtype=np.uint64)
    k = 0
    while n:
        if n & 1:
            v = _apply(_doubling(k), v)
        n >>= 1
        k += 1
    return int(v[0])


def crc64(data: bytes | memoryview, crc: int = 0) -> int:
    """The code of data after what has code crc."""
    n = len(data)
    if n < 64:
        t8 = _tables()[0]
        for b in bytes(data):
            crc = int(t8[(crc ^ b) & 255]) ^ (crc >> 8)
        return crc
    lanes = 1 << max(0, (n - 1) // LANE).bit_length()
    padded = np.zeros(lanes * LANE, dtype=np.uint8)  # zeros in front leave the code 0
    padded[len(padded) - n :] = np.frombuffer(data, dtype=np.uint8)
    columns = np.ascontiguousarray(padded.view("<u2").reshape(lanes, LANE // 2).T)
    t16, low, sixteen = _tables()[1], np.uint64(0xFFFF), np.uint64(16)
    state = np.zeros(lanes, dtype=np.uint64)
    for column in columns:
        state = t16[(state ^ column) & low] ^ (state >> sixteen)
    k = LANE.bit_length() - 1
    while len(state) > 1:
        state = _apply(_doubling(k), state[0::2]) ^ state[1::2]
        k += 1
    return int(state[0]) ^ (shift(crc, n) if crc else 0)

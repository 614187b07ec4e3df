"""Small row groups into large ones, page by page.

A merged group has one chunk per column: one dictionary of all its groups' dictionary entries, and their pages. What is
rewritten are levels and dictionary indexes, the streams that say which value stands where; the values themselves are
moved as the encoded bytes that they are. Pages that are large enough, or of an encoding that has no such streams, are
copied with their headers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import thriftcompact as tc

#: A page of so many values, or bytes, is large enough to be copied; smaller ones are put together until they are.
PAGE_VALUES, PAGE_BYTES = 20_000, 1 << 20
#: A merged dictionary's bytes; what doesn't fit any more is written plain, as writers do.
DICTIONARY_BYTES = 1 << 20

# Field ids of schema elements, column metadata, statistics and page headers.
ELEMENT_TYPE, ELEMENT_LENGTH, ELEMENT_REPETITION, ELEMENT_CHILDREN, ELEMENT_CONVERTED, ELEMENT_LOGICAL = 1, 2, 3, 5, 6, 10
COLUMN_TYPE, COLUMN_ENCODINGS, COLUMN_PATH, COLUMN_CODEC, COLUMN_VALUES, COLUMN_PLAIN_SIZE, COLUMN_SIZE, COLUMN_DATA, COLUMN_DICTIONARY, COLUMN_STATISTICS = 1, 2, 3, 4, 5, 6, 7, 9, 11, 12
STAT_NULLS, STAT_MAX, STAT_MIN, STAT_MAX_EXACT, STAT_MIN_EXACT = 3, 5, 6, 7, 8
PAGE_TYPE, PAGE_PLAIN_SIZE, PAGE_SIZE, PAGE_V1, PAGE_DICTIONARY, PAGE_V2 = 1, 2, 3, 5, 7, 8
DATA, DICTIONARY, DATA_V2 = 0, 2, 3
# Physical types and their widths, repetitions, encodings, and codecs by pyarrow's names.
BOOLEAN, INT32, INT64, INT96, FLOAT, DOUBLE, BYTES, FIXED = range(8)
WIDTHS = {INT32: 4, INT64: 8, INT96: 12, FLOAT: 4, DOUBLE: 8}
REQUIRED, REPEATED = 0, 2
PLAIN, PLAIN_DICTIONARY, RLE, BIT_PACKED, RLE_DICTIONARY = 0, 2, 3, 4, 8
CODECS = {0: None, 1: "snappy", 2: "gzip", 4: "brotli", 6: "zstd", 7: "lz4_raw"}


@dataclass(frozen=True)
class Leaf:
    """A column: physical type, width of fixed values, levels, and how its statistics compare (None: they don't)."""

    physical: int
    width: int | None
    max_def: int
    max_rep: int
    order: str | None


def _order(physical: int, converted: int | None, logical: dict | None) -> str | None:
    # Converted types 0 UTF8, 4 ENUM, 11 to 14 unsigned, 19 JSON, 20 BSON; logical 1 string, 4 enum, 10 integer (2: signed), 12 JSON, 13 BSON.
    kind = next(iter(logical), None) if logical else None
    if physical in (BYTES, FIXED):
        return "bytes" if converted in (None, 0, 4, 19, 20) and kind in (None, 1, 4, 12, 13) else None
    if physical in (INT32, INT64):
        unsigned = converted in (11, 12, 13, 14) or (kind == 10 and not logical[10][1][2][1])
        return {(INT32, False): "<i", (INT32, True): "<I", (INT64, False): "<q", (INT64, True): "<Q"}[physical, unsigned]
    return {BOOLEAN: "bytes", FLOAT: "<f", DOUBLE: "<d"}.get(physical)


def leaves(elements: Sequence[dict]) -> list[Leaf]:
    """The columns of a schema, which lists a tree's nodes from the root down."""
    out: list[Leaf] = []

    def walk(at: int, d: int, r: int) -> int:
        element = elements[at]
        get = lambda i, default=None: element[i][1] if i in element else default
        if at:
            repetition = get(ELEMENT_REPETITION, REQUIRED)
            d, r = d + (repetition != REQUIRED), r + (repetition == REPEATED)
        children = get(ELEMENT_CHILDREN, 0)
        if at and not children:
            physical = get(ELEMENT_TYPE)
            width = get(ELEMENT_LENGTH) if physical == FIXED else WIDTHS.get(physical)
            out.append(Leaf(physical, width, d, r, _order(physical, get(ELEMENT_CONVERTED), get(ELEMENT_LOGICAL))))
        at += 1
        for _ in range(children):
            at = walk(at, d, r)
        return at

    walk(0, 0, 0)
    return out


def decode_runs(data: bytes, at: int, end: int, width: int, n: int) -> np.ndarray:
    """n numbers of width bits from a stream of runs: repeated ones, and packed ones in eights."""
    if width == 0 or n == 0:
        return np.zeros(n, dtype=np.int64)
    parts, got, size = [], 0, (width + 7) // 8
    while got < n:
        head = shift = 0
        while True:
            b = data[at]
            at += 1
            head |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
        if head & 1:
            stop = min(at + (head >> 1) * width, end)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, stop - at, at), bitorder="little")
            bits = bits[: len(bits) // width * width].reshape(-1, width)
            part = bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)) if width > 1 else bits[:, 0].astype(np.int64)
            at = stop
        else:
            part = np.full(head >> 1, int.from_bytes(data[at : at + size], "little"), dtype=np.int64)
            at += size
        if not len(part):
            raise ValueError("a run without values")
        parts.append(part)
        got += len(part)
    return (parts[0] if len(parts) == 1 else np.concatenate(parts))[:n]


def _uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_runs(values: np.ndarray, width: int) -> bytes:
    """The numbers as runs: repeated ones where runs are long on average, else all packed."""
    n = len(values)
    if n == 0:
        return b""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, n)
    if len(ends) <= 1 + n // 32:
        size, out, start = (width + 7) // 8, [], 0
        for end in ends.tolist():
            out.append(_uvarint((end - start) << 1) + int(values[start]).to_bytes(size, "little"))
            start = end
        return b"".join(out)
    padded = np.zeros(-(-n // 8) * 8, dtype=np.int64)
    padded[:n] = values
    bits = (padded[:, None] >> np.arange(width, dtype=np.int64)) & 1
    return _uvarint(len(padded) // 8 << 1 | 1) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def page_headers(chunk: bytes) -> Iterator[tuple[dict, int, int, int]]:
    """(header, where it begins, where the body begins, where it ends) of a chunk's pages."""
    end = 0
    while end < len(chunk):
        start = end
        header, body = tc.read_struct(chunk, start)
        end = body + header[PAGE_SIZE][1]
        if end > len(chunk):
            raise ValueError("a page ends behind its chunk")
        yield header, start, body, end


class _Column:
    """One chunk of a merged group, growing."""

    def __init__(self, leaf: Leaf, meta: dict):
        self.leaf, self.meta = leaf, meta
        name = CODECS[meta[COLUMN_CODEC][1]]
        self.codec = pa.Codec(name) if name else None
        self.def_width, self.rep_width = leaf.max_def.bit_length(), leaf.max_rep.bit_length()
        self.ids: dict[bytes, int] = {}  # dictionary entries, as the plain encoding writes them
        self.id_bytes = 0
        self.pages: list[bytes] = []
        self.encodings: set[int] = {RLE}
        self.values = self.plain_size = self.size = 0
        self.nulls: int | None = 0
        self.low = self.high = None
        self.exact = [True, True]
        self.bounded = leaf.order is not None
        self._clear()

    def _clear(self) -> None:
        self.reps, self.defs, self.parts = [], [], []
        self.kind: int | None = None  # PLAIN or RLE_DICTIONARY once a value is pending
        self.pending = self.pending_bytes = 0

    def _open(self, data: bytes, size: int) -> bytes:
        if not size:  # a compressed nothing may have bytes
            return b""
        return self.codec.decompress(data, decompressed_size=size, asbytes=True) if self.codec else data

    def _entries(self, body: bytes, n: int) -> list[bytes]:
        if self.leaf.physical == BYTES:
            out, at = [], 0
            for _ in range(n):
                end = at + 4 + int.from_bytes(body[at : at + 4], "little")
                out.append(body[at:end])
                at = end
        else:
            w = self.leaf.width
            out = [body[i : i + w] for i in range(0, n * w, w)]
        if sum(map(len, out)) != len(body):
            raise ValueError("a dictionary of another size than stated")
        return out

    def _merged(self, own: list[bytes]) -> np.ndarray | None:
        """The place of each of a chunk's dictionary entries in the merged dictionary; None if that is full."""
        fresh = sum(len(e) for e in own if e not in self.ids)
        if self.id_bytes + fresh > DICTIONARY_BYTES:
            return None
        self.id_bytes += fresh
        return np.array([self.ids.setdefault(e, len(self.ids)) for e in own], dtype=np.int64)

    def add(self, chunk: bytes, meta: dict) -> None:
        own: list[bytes] = []
        places: np.ndarray | None = None
        for header, start, body, end in page_headers(chunk):
            kind = header[PAGE_TYPE][1]
            if kind == DICTIONARY:
                h = header[PAGE_DICTIONARY][1]
                own = self._entries(self._open(chunk[body:end], header[PAGE_PLAIN_SIZE][1]), h[1][1])
                places = self._merged(own)
            elif kind in (DATA, DATA_V2):
                self._data(header, chunk[start:body], chunk[body:end], own, places)
        self.values += meta[COLUMN_VALUES][1]
        self._bound(meta)

    def _data(self, header: dict, head: bytes, raw: bytes, own: list[bytes], places: np.ndarray | None) -> None:
        v2 = header[PAGE_TYPE][1] == DATA_V2
        h = header[PAGE_V2 if v2 else PAGE_V1][1]
        n, encoding = h[1][1], h[4][1] if v2 else h[2][1]
        indexed = encoding in (PLAIN_DICTIONARY, RLE_DICTIONARY)
        same = not indexed or (places is not None and bool((places == np.arange(len(places))).all()))
        movable = indexed or encoding == PLAIN or (encoding == RLE and self.leaf.physical == BOOLEAN)
        if same and (not movable or n >= PAGE_VALUES or len(raw) >= PAGE_BYTES):
            self.flush()
            self._page(head, raw, header[PAGE_PLAIN_SIZE][1], encoding)
            return
        plain_size = header[PAGE_PLAIN_SIZE][1]
        at = 0
        if v2:
            n_def, n_rep = h[5][1], h[6][1]
            levels, rest = raw[: n_rep + n_def], raw[n_rep + n_def :]
            reps = decode_runs(levels, 0, n_rep, self.rep_width, n)
            defs = decode_runs(levels, n_rep, n_rep + n_def, self.def_width, n)
            body = self._open(rest, plain_size - n_rep - n_def) if 7 not in h or h[7][1] else rest
        else:
            body = self._open(raw, plain_size)
            reps, at = self._levels(body, at, self.rep_width, h[4][1], n)
            defs, at = self._levels(body, at, self.def_width, h[3][1], n)
        self._keep(n, reps, defs, body, at, encoding, indexed, own, places)

    @staticmethod
    def _levels(body: bytes, at: int, width: int, encoding: int, n: int) -> tuple[np.ndarray | None, int]:
        """A page's levels of one kind, and where what follows them begins."""
        if not width:
            return None, at
        if encoding == BIT_PACKED:  # of old writers: no length, and the high bit first
            stop = at + -(-n * width // 8)
            bits = np.unpackbits(np.frombuffer(body, np.uint8, stop - at, at))[: n * width].reshape(n, width)
            return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)), stop
        stop = at + 4 + int.from_bytes(body[at : at + 4], "little")
        return decode_runs(body, at + 4, stop, width, n), stop

    def _keep(self, n, reps, defs, body, at, encoding, indexed, own, places) -> None:
        present = n if not self.leaf.max_def else int((defs == self.leaf.max_def).sum())
        kind, part = None, None
        if present:
            if indexed:
                at_values = decode_runs(body, at + 1, len(body), body[at], present)
                if places is not None:
                    kind, part = RLE_DICTIONARY, places[at_values]
                else:
                    kind, part = PLAIN, b"".join([own[i] for i in at_values.tolist()])
            elif self.leaf.physical == BOOLEAN:
                kind = PLAIN
                part = decode_runs(body, at + 4, len(body), 1, present) if encoding == RLE else np.unpackbits(np.frombuffer(body, np.uint8, offset=at), bitorder="little")[:present]
            else:
                kind, part = PLAIN, body[at:]
            if self.kind is not None and self.kind != kind:
                self.flush()
            self.kind = kind
            self.parts.append(part)
            self.pending_bytes += len(part)
        if self.leaf.max_rep:
            self.reps.append(reps)
        if self.leaf.max_def:
            self.defs.append(defs)
        self.pending += n
        if self.pending >= PAGE_VALUES or self.pending_bytes >= PAGE_BYTES:
            self.flush()

    def flush(self) -> None:
        """Write the pending values as a page."""
        if not self.pending:
            return
        body = []
        for levels, width in ((self.reps, self.rep_width), (self.defs, self.def_width)):
            if width:
                stream = encode_runs(np.concatenate(levels), width)
                body.append(struct.pack("<I", len(stream)) + stream)
        encoding = PLAIN if self.kind is None else self.kind
        if self.kind == RLE_DICTIONARY:
            width = max(1, (len(self.ids) - 1).bit_length())
            body.append(bytes([width]) + encode_runs(np.concatenate(self.parts), width))
        elif self.leaf.physical == BOOLEAN:
            body += [np.packbits(np.concatenate(self.parts).astype(np.uint8), bitorder="little").tobytes()] if self.parts else []
        else:
            body += self.parts
        plain = b"".join(body)
        raw = self.codec.compress(plain, asbytes=True) if self.codec else plain
        header = {1: (tc.I32, DATA), 2: (tc.I32, len(plain)), 3: (tc.I32, len(raw)), 5: (tc.STRUCT, {1: (tc.I32, self.pending), 2: (tc.I32, encoding), 3: (tc.I32, RLE), 4: (tc.I32, RLE)})}
        self._page(tc.struct_bytes(header), raw, len(plain), encoding)
        self._clear()

    def _page(self, head: bytes, raw: bytes, plain_size: int, encoding: int) -> None:
        self.pages += [head, raw]
        self.encodings.add(RLE_DICTIONARY if encoding == PLAIN_DICTIONARY else encoding)
        self.plain_size += len(head) + plain_size
        self.size += len(head) + len(raw)

    def _bound(self, meta: dict) -> None:
        """Statistics hold for the merged chunk only as far as all chunks have them."""
        if not meta[COLUMN_VALUES][1]:
            return
        s = meta.get(COLUMN_STATISTICS, (0, {}))[1]
        nulls = s[STAT_NULLS][1] if STAT_NULLS in s else None
        self.nulls = None if self.nulls is None or nulls is None else self.nulls + nulls
        if not self.bounded or nulls == meta[COLUMN_VALUES][1]:
            return
        if STAT_MIN not in s or STAT_MAX not in s:
            self.bounded = False
            return
        read = (lambda b: b) if self.leaf.order == "bytes" else lambda b: struct.unpack(self.leaf.order, b)[0]
        low, high = s[STAT_MIN][1], s[STAT_MAX][1]
        if self.low is None or read(low) < read(self.low):
            self.low = low
        if self.high is None or read(high) > read(self.high):
            self.high = high
        self.exact = [e and s.get(i, (0, True))[1] for e, i in zip(self.exact, (STAT_MIN_EXACT, STAT_MAX_EXACT))]

    def close(self, at: int) -> tuple[list[bytes], dict]:
        """The chunk's bytes and its metadata if it begins at `at`."""
        self.flush()
        first = []
        if self.ids:
            plain = b"".join(self.ids)
            raw = self.codec.compress(plain, asbytes=True) if self.codec else plain
            head = tc.struct_bytes({1: (tc.I32, DICTIONARY), 2: (tc.I32, len(plain)), 3: (tc.I32, len(raw)), 7: (tc.STRUCT, {1: (tc.I32, len(self.ids)), 2: (tc.I32, PLAIN)})})
            first = [head, raw]
            self.plain_size += len(head) + len(plain)
            self.size += len(head) + len(raw)
            self.encodings.add(PLAIN)
        meta = {k: self.meta[k] for k in (COLUMN_TYPE, COLUMN_PATH, COLUMN_CODEC)}
        meta[COLUMN_ENCODINGS] = (tc.LIST, (tc.I32, sorted(self.encodings)))
        meta[COLUMN_VALUES], meta[COLUMN_PLAIN_SIZE], meta[COLUMN_SIZE] = (tc.I64, self.values), (tc.I64, self.plain_size), (tc.I64, self.size)
        meta[COLUMN_DATA] = (tc.I64, at + sum(map(len, first)))
        if first:
            meta[COLUMN_DICTIONARY] = (tc.I64, at)
        statistics = {} if self.nulls is None else {STAT_NULLS: (tc.I64, self.nulls)}
        if self.bounded and self.low is not None:
            statistics |= {STAT_MAX: (tc.BINARY, self.high), STAT_MIN: (tc.BINARY, self.low)}
            if not all(self.exact):
                statistics |= {STAT_MAX_EXACT: (tc.TRUE, self.exact[1]), STAT_MIN_EXACT: (tc.TRUE, self.exact[0])}
        if statistics:
            meta[COLUMN_STATISTICS] = (tc.STRUCT, statistics)
        return first + self.pages, meta


class GroupMerger:
    """A merged group, growing. Its columns' codecs are those of the first group."""

    def __init__(self, elements: Sequence[dict], metas: Sequence[dict]):
        self.columns = [_Column(leaf, meta) for leaf, meta in zip(leaves(elements), metas, strict=True)]
        self.rows = 0

    @staticmethod
    def codecs(metas: Sequence[dict]) -> tuple[int, ...] | None:
        """What groups must agree in to be merged; None where a codec is unknown."""
        found = tuple(m[COLUMN_CODEC][1] for m in metas)
        return found if all(c in CODECS for c in found) else None

    def add(self, rows: int, chunks: Sequence[tuple[bytes, dict]]) -> None:
        for column, (chunk, meta) in zip(self.columns, chunks, strict=True):
            column.add(chunk, meta)
        self.rows += rows

    @property
    def bytes(self) -> int:
        return sum(c.size + c.pending_bytes + c.id_bytes for c in self.columns)

    def close(self, at: int) -> Iterator[tuple[list[bytes], dict]]:
        """Bytes and metadata of each column's chunk, the first at `at`."""
        for column in self.columns:
            if not column.leaf.max_rep and column.values != self.rows:
                raise ValueError(f"a column has {column.values} values in {self.rows} rows")
            parts, meta = column.close(at)
            yield parts, meta
            at += meta[COLUMN_SIZE][1]

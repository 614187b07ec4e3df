"""Writes snapshot bytes for tests and for the queries over the test tables; the product itself only reads."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

from keyquarry.codec import names as N
from keyquarry.codec.crc64 import crc64


def length(n: int) -> bytes:
    if n < 64:
        return bytes([n])
    if n < 1 << 14:
        return bytes([0x40 | n >> 8, n & 255])
    return b"\x80" + n.to_bytes(4, "big") if n < 1 << 32 else b"\x81" + n.to_bytes(8, "big")


def string(b: bytes) -> bytes:
    return length(len(b)) + b


def int_string(n: int) -> bytes:
    """A whole number in the shortest of the three integer forms."""
    for kind, width in ((0, 1), (1, 2), (2, 4)):
        if -(1 << 8 * width - 1) <= n < 1 << 8 * width - 1:
            return bytes([0xC0 | kind]) + n.to_bytes(width, "little", signed=True)
    return string(b"%d" % n)


def lzf(data: bytes) -> bytes:
    """Compressed by a table of three-byte positions; any valid encoding will do."""
    out, literal, seen, i, n = bytearray(), bytearray(), {}, 0, len(data)

    def flush() -> None:
        for k in range(0, len(literal), 32):
            piece = literal[k : k + 32]
            out.append(len(piece) - 1)
            out.extend(piece)
        literal.clear()

    while i < n:
        three = data[i : i + 3]
        at = seen.get(three, -1) if len(three) == 3 else -1
        if len(three) == 3:
            seen[three] = i
        back = i - at - 1
        if at < 0 or back >= 1 << 13:
            literal.append(data[i])
            i += 1
            continue
        size = 3
        while size < 264 and i + size < n and data[at + size] == data[i + size]:
            size += 1
        flush()
        if size - 2 < 7:
            out.append(size - 2 << 5 | back >> 8)
        else:
            out += bytes([0xE0 | back >> 8, size - 9])
        out.append(back & 255)
        i += size
    flush()
    return bytes(out)


def lzf_string(data: bytes) -> bytes:
    packed = lzf(data)
    return b"\xc3" + length(len(packed)) + length(len(data)) + packed


def whole_number(b: bytes) -> int | None:
    """The number that b is the plain decimal text of, if it fits 64 bits."""
    if not b or len(b) > 20 or not (b.isdigit() or b[:1] == b"-" and b[1:].isdigit()):
        return None
    n = int(b)
    return n if b"%d" % n == b and -(2**63) <= n < 2**63 else None


def _lp_entry(e: bytes | int) -> bytes:
    n = e if isinstance(e, int) else whole_number(e)
    if n is not None:
        if 0 <= n < 128:
            body = bytes([n])
        elif -4096 <= n < 4096:
            body = bytes([0xC0 | n >> 8 & 31, n & 255])
        else:
            for mark, width in ((0xF1, 2), (0xF2, 3), (0xF3, 4), (0xF4, 8)):
                if -(1 << 8 * width - 1) <= n < 1 << 8 * width - 1:
                    body = bytes([mark]) + n.to_bytes(width, "little", signed=True)
                    break
    elif len(e) < 64:
        body = bytes([0x80 | len(e)]) + e
    elif len(e) < 4096:
        body = bytes([0xE0 | len(e) >> 8, len(e) & 255]) + e
    else:
        body = b"\xf0" + len(e).to_bytes(4, "little") + e
    size = len(body)
    groups = 1 if size <= 127 else 2 if size < 16383 else 3 if size < 2097151 else 4 if size < 268435455 else 5
    back = bytes((size >> 7 * (groups - 1 - i) & 127) | (128 if i else 0) for i in range(groups))
    return body + back


def listpack(elements: Sequence[bytes | int]) -> bytes:
    body = b"".join(map(_lp_entry, elements))
    return struct.pack("<IH", len(body) + 7, min(len(elements), 65535)) + body + b"\xff"


def ziplist(elements: Sequence[bytes | int]) -> bytes:
    out, previous, tail = bytearray(), 0, 10
    for e in elements:
        tail = 10 + len(out)
        n = e if isinstance(e, int) else whole_number(e)
        if n is not None and 0 <= n <= 12:
            body = bytes([0xF1 + n])
        elif n is not None:
            for mark, width in ((0xFE, 1), (0xC0, 2), (0xF0, 3), (0xD0, 4), (0xE0, 8)):
                if -(1 << 8 * width - 1) <= n < 1 << 8 * width - 1:
                    body = bytes([mark]) + n.to_bytes(width, "little", signed=True)
                    break
        elif len(e) < 64:
            body = bytes([len(e)]) + e
        elif len(e) < 1 << 14:
            body = bytes([0x40 | len(e) >> 8, len(e) & 255]) + e
        else:
            body = b"\x80" + len(e).to_bytes(4, "big") + e
        entry = (bytes([previous]) if previous < 254 else b"\xfe" + previous.to_bytes(4, "little")) + body
        previous = len(entry)
        out += entry
    return struct.pack("<IIH", len(out) + 11, tail, min(len(elements), 65535)) + bytes(out) + b"\xff"


def intset(numbers: Iterable[int]) -> bytes:
    ns = sorted(numbers)
    width = next(w for w in (2, 4, 8) if not ns or -(1 << 8 * w - 1) <= ns[0] and ns[-1] < 1 << 8 * w - 1)
    return struct.pack("<II", width, len(ns)) + b"".join(n.to_bytes(width, "little", signed=True) for n in ns)


def quicklist2(elements: Sequence[bytes], node: int = 128) -> bytes:
    """Nodes of listpacks; an element of over 8 KiB stands alone."""
    nodes, pack = [], []
    for e in elements:
        if len(e) > 8192:
            if pack:
                nodes.append(b"\x02" + string(listpack(pack)))
                pack = []
            nodes.append(b"\x01" + string(e))
            continue
        pack.append(e)
        if len(pack) == node:
            nodes.append(b"\x02" + string(listpack(pack)))
            pack = []
    if pack:
        nodes.append(b"\x02" + string(listpack(pack)))
    return length(len(nodes)) + b"".join(nodes)


def quicklist1(elements: Sequence[bytes], node: int = 128) -> bytes:
    nodes = [elements[i : i + node] for i in range(0, len(elements), node)]
    return length(len(nodes)) + b"".join(string(ziplist(x)) for x in nodes)


def plain_strings(elements: Sequence[bytes]) -> bytes:
    return length(len(elements)) + b"".join(map(string, elements))


def text_score(x: float) -> bytes:
    if x != x:
        return b"\xfd"
    if x in (float("inf"), float("-inf")):
        return b"\xfe" if x > 0 else b"\xff"
    t = repr(x).encode()
    return bytes([len(t)]) + t


def score_text(x: float) -> bytes | int:
    return int(x) if x == int(x) and abs(x) < 2**53 else repr(x).encode()


def module_id(name: str, version: int) -> int:
    out = 0
    for c in name:
        out = out << 6 | N.MODULE_ALPHABET.index(c)
    return out << 10 | version


def module(name: str, version: int, values: Sequence[tuple[str, object]]) -> bytes:
    ops = {v: k for k, v in N.MODULE_OPCODES.items()}
    out = [length(module_id(name, version))]
    for op, v in values:
        out.append(length(ops[op]))
        out.append(struct.pack("<f", v) if op == "float" else struct.pack("<d", v) if op == "double" else string(v) if op == "string" else length(v))
    return b"".join(out) + b"\x00"


def stream(entries: Sequence[tuple[int, int, Sequence[tuple[bytes, bytes]]]], code: int = N.STREAM_3, node: int = 100, groups: bytes = b"\x00", deleted: Iterable[int] = ()) -> bytes:
    """Entries (ms, seq, fields) in order of id; those at the places in deleted are marked as deleted."""
    gone, nodes = set(deleted), []
    for at in range(0, len(entries), node):
        part = entries[at : at + node]
        ms, seq = part[0][0], min(s for _, s, _ in part)
        master = [f for f, _ in part[0][2]]
        dead = sum(at + i in gone for i in range(len(part)))
        items: list = [len(part) - dead, dead, len(master), *master, 0]
        for i, (m, s, fields) in enumerate(part):
            same = [f for f, _ in fields] == master
            items += [(1 if at + i in gone else 0) | (2 if same else 0), m - ms, s - seq]
            values = [v for _, v in fields] if same else [len(fields), *[x for p in fields for x in p]]
            items += [*values, len(values) + 3]
        nodes.append(string(struct.pack(">QQ", ms, seq)) + string(listpack(items)))
    live = [e for i, e in enumerate(entries) if i not in gone]
    last = entries[-1][:2] if entries else (0, 0)
    first = live[0][:2] if live else (0, 0)
    tail = [len(live), *last] + ([] if code == N.STREAM_1 else [*first, 0, 0, len(entries)])
    return length(len(nodes)) + b"".join(nodes) + b"".join(map(length, tail)) + groups


def consumer_groups(code: int, names: Sequence[bytes] = (b"g",), pending: int = 2) -> bytes:
    out = [length(len(names))]
    for name in names:
        out.append(string(name) + length(5) + length(0) + (b"" if code == N.STREAM_1 else length(1)))
        out.append(length(pending) + b"".join(struct.pack(">QQ", 5, i) + bytes(8) + length(1) for i in range(pending)))
        out.append(length(1) + string(b"c") + bytes(16 if code == N.STREAM_3 else 8) + length(pending) + b"".join(struct.pack(">QQ", 5, i) for i in range(pending)))
    return b"".join(out)


class Snapshot:
    """Bytes of one file, put together entry by entry."""

    def __init__(self, magic: str = "VALKEY", version: int = 80, aux: dict[str, str] | None = None):
        self.version = version
        self.parts = [b"VALKEY%03d" % version if magic == "VALKEY" else b"REDIS%04d" % version]
        self.db: int | None = None
        for k, v in (aux if aux is not None else {"valkey-ver" if magic == "VALKEY" else "redis-ver": "8.0.1", "ctime": "1704067200", "used-mem": "1048576", "repl-id": "0" * 40, "repl-offset": "0"}).items():
            self.raw(bytes([N.OP_AUX]) + string(k.encode()) + string(v.encode()))

    def raw(self, b: bytes) -> Snapshot:
        self.parts.append(b)
        return self

    def select(self, db: int) -> Snapshot:
        if db != self.db:
            self.db = db
            self.raw(bytes([N.OP_SELECTDB]) + length(db))
        return self

    def add(self, code: int, key: bytes, body: bytes, db: int = 0, expiry_ms: int | None = None, idle: int | None = None, freq: int | None = None) -> Snapshot:
        self.select(db)
        if expiry_ms is not None:
            self.raw(bytes([N.OP_EXPIRETIME_MS]) + struct.pack("<q", expiry_ms))
        if idle is not None:
            self.raw(bytes([N.OP_IDLE]) + length(idle))
        if freq is not None:
            self.raw(bytes([N.OP_FREQ, freq]))
        return self.raw(bytes([code]) + string(key) + body)

    def bytes(self, crc: int | None = None) -> bytes:
        data = b"".join([*self.parts, bytes([N.OP_EOF])])
        return data + struct.pack("<Q", crc64(data) if crc is None else crc)

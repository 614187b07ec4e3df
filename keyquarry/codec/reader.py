"""From the bytes of a snapshot to its entries."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from . import names as N
from .batches import Packed
from .crc64 import crc64
from .errors import CorruptData, InvalidMagic, Truncated, UnknownType, UnsupportedVersion
from .packed import field_pairs, intset, listpack, lzf_decompress, scored_pairs, text_float, ziplist
from .streams import read_stream

BLOCK = 4 << 20
DOUBLE = struct.Struct("<d").unpack_from


@dataclass
class Header:
    magic: str
    version: int
    aux: dict[str, str] = field(default_factory=dict)

    @property
    def server_version(self) -> str | None:
        # The names under which servers state their version.
        return self.aux.get("valkey-ver", self.aux.get("redis-ver"))

    def number(self, name: str, low: int, high: int) -> int | None:
        text = self.aux.get(name, "")
        digits = text[1:] if text[:1] in ("+", "-") else text
        if not (digits.isascii() and digits.isdigit()):
            return None
        n = int(text)
        return n if low <= n <= high else None

    @property
    def ctime(self) -> int | None:
        return self.number("ctime", 0, 2**64 - 1)

    @property
    def used_mem(self) -> int | None:
        return self.number("used-mem", 0, 2**64 - 1)

    @property
    def repl_id(self) -> str | None:
        return self.aux.get("repl-id")

    @property
    def repl_offset(self) -> int | None:
        return self.number("repl-offset", -(2**63), 2**63 - 1)


class Entry(NamedTuple):
    """One key, or one chunk of a long key (then total and offset are set)."""

    db: int
    key: bytes
    code: int
    expiry_ms: int | None
    idle: int | None
    freq: int | None
    value: object
    total: int | None = None
    offset: int | None = None


class Source:
    """A buffered input that keeps the CRC of what has been taken."""

    def __init__(self, raw, verify: bool = True, base: int = 0):
        self.raw, self.verify, self.base = raw, verify, base
        self.buf, self.at, self.size, self.crc = b"", 0, 0, 0

    @property
    def position(self) -> int:
        return self.base + self.at

    def _more(self, n: int) -> None:
        if self.verify and self.at:
            self.crc = crc64(memoryview(self.buf)[: self.at], self.crc)
        parts, have = [self.buf[self.at :]], len(self.buf) - self.at
        self.base += self.at
        self.at = 0
        while have < n:
            part = self.raw.read(max(BLOCK, n - have))
            if not part:
                self.buf, self.size = b"".join(parts), have
                raise Truncated(f"the file ends within a value: {n} bytes wanted, {have} left")
            parts.append(part)
            have += len(part)
        self.buf, self.size = b"".join(parts), have

    def take(self, n: int) -> bytes:
        end = self.at + n
        if end > self.size:
            self._more(n)
            end = n
        out = self.buf[self.at : end]
        self.at = end
        return out

    def byte(self) -> int:
        if self.at >= self.size:
            self._more(1)
        b = self.buf[self.at]
        self.at += 1
        return b

    def code_so_far(self) -> int:
        return crc64(memoryview(self.buf)[: self.at], self.crc)

    def length_or_special(self) -> tuple[int, bool]:
        b = self.byte()
        kind = b >> 6
        if kind == 0:
            return b, False
        if kind == 1:
            return (b & 0x3F) << 8 | self.byte(), False
        if kind == 3:
            return b & 0x3F, True
        if b == 0x80:
            return int.from_bytes(self.take(4), "big"), False
        if b == 0x81:
            return int.from_bytes(self.take(8), "big"), False
        raise CorruptData(f"unknown length encoding {b:#x}")

    def length(self) -> int:
        n, special = self.length_or_special()
        if special:
            raise CorruptData("a string encoding where a length should be")
        return n

    def count(self) -> int:
        n = self.length()
        if n > N.MAX_ALLOCATION:
            raise CorruptData(f"a count of {n}")
        return n

    def string(self) -> bytes:
        at = self.at
        if at < self.size:
            n = self.buf[at]
            if n < 64:  # one byte of length, and all of the string in the buffer
                end = at + 1 + n
                if end <= self.size:
                    self.at = end
                    return self.buf[at + 1 : end]
            elif n < 128 and at + 2 <= self.size:  # two bytes of length
                end = at + 2 + ((n & 63) << 8 | self.buf[at + 1])
                if end <= self.size:
                    self.at = end
                    return self.buf[at + 2 : end]
        n, special = self.length_or_special()
        if not special:
            if n > N.MAX_ALLOCATION:
                raise CorruptData(f"a string of {n} bytes")
            return self.take(n)
        if n < 3:
            return b"%d" % int.from_bytes(self.take(1 << n), "little", signed=True)
        if n == 3:
            packed, size = self.count(), self.count()
            return lzf_decompress(self.take(packed), size)
        raise CorruptData(f"unknown string encoding {n}")

    def skip_string(self) -> None:
        at = self.at
        if at < self.size and (n := self.buf[at]) < 64 and at + 1 + n <= self.size:
            self.at = at + 1 + n
            return
        n, special = self.length_or_special()
        if not special:
            if n > N.MAX_ALLOCATION:
                raise CorruptData(f"a string of {n} bytes")
            self.take(n)
        elif n < 3:
            self.take(1 << n)
        elif n == 3:
            packed = self.count()
            self.count()
            self.take(packed)
        else:
            raise CorruptData(f"unknown string encoding {n}")

    def double(self) -> float:
        at = self.at
        if at + 8 <= self.size:
            self.at = at + 8
            return DOUBLE(self.buf, at)[0]
        return DOUBLE(self.take(8))[0]

    def text_double(self) -> float:
        n = self.byte()
        if n >= 253:
            return {253: float("nan"), 254: float("inf"), 255: float("-inf")}[n]
        return text_float(self.take(n))


def module_name(identity: int) -> tuple[str, int]:
    """(name, version) packed into a module's id."""
    return "".join(N.MODULE_ALPHABET[identity >> shift & 63] for shift in range(58, 9, -6)), identity & 1023


def read_module_values(source: Source, keep: bool) -> list[tuple[str, int | None, float | None, bytes | None]]:
    """(opcode, whole number, float, string) of each value until the end mark."""
    out, size = [], 0
    while True:
        op = source.length()
        if op == N.MODULE_EOF:
            return out
        if op in (N.MODULE_SINT, N.MODULE_UINT):
            n = source.length()
            one = (N.MODULE_OPCODES[op], n, None, None)
        elif op == N.MODULE_FLOAT:
            one = ("float", None, struct.unpack("<f", source.take(4))[0], None)
        elif op == N.MODULE_DOUBLE:
            one = ("double", None, struct.unpack("<d", source.take(8))[0], None)
        elif op == N.MODULE_STRING:
            text = source.string()
            size += len(text)
            one = ("string", None, None, text)
        else:
            raise CorruptData(f"module: unknown opcode {op}")
        if keep:
            if len(out) >= N.MAX_MODULE_VALUES or size > N.MAX_MODULE_BYTES:
                raise CorruptData("module: too many values")
            out.append(one)


class SnapshotReader:
    """Entries of one snapshot, in order. `wanted(db, key, code)` decides before a value is decoded whether it is. With
    shallow, values that decide no type (all but those of strings and sorted sets) are passed over, their entries aren't. With
    keep_packed, values that are listpacks stay so, to be decoded together."""

    def __init__(self, raw, max_key_elements: int | None = N.DEFAULT_CHUNK, verify_crc: bool = True, wanted: Callable[[int, bytes, int], bool] | None = None, shallow: bool = False, keep_packed: bool = False):
        if max_key_elements is not None and max_key_elements < 1:
            raise ValueError("max_key_elements must be 1 or more")
        self.source = Source(raw, verify_crc)
        self.verify, self.chunk, self.wanted, self.shallow, self.keep_packed = verify_crc, max_key_elements, wanted, shallow, keep_packed
        self.crc_checked = False
        self.skipped_unknown = 0
        self.db, self.end = 0, None
        self.header = self._read_header()
        self._ahead: int | None = None
        while (b := self.source.byte()) == N.OP_AUX:
            self._read_aux()
        self._ahead = b

    @classmethod
    def of_part(cls, raw, start: int, end: int, db: int, max_key_elements: int | None = N.DEFAULT_CHUNK, wanted: Callable[[int, bytes, int], bool] | None = None, shallow: bool = False, keep_packed: bool = False) -> SnapshotReader:
        """A reader of the bytes from start to end, which parts() gave; raw stands at start."""
        self = cls.__new__(cls)
        self.source = Source(raw, False, start)
        self.verify, self.chunk, self.wanted, self.shallow, self.keep_packed = False, max_key_elements, wanted, shallow, keep_packed
        self.crc_checked, self.skipped_unknown = False, 0
        self.db, self.end = db, end
        self.header, self._ahead = Header("", 0), None
        return self

    def parts(self, size: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, db) of parts of about size bytes, cut between entries; no value is decoded, the CRC is compared.

        Between entries nothing but the db is carried over, so the parts can be read apart from each other. The last
        one reaches to the end mark.
        """
        self.wanted = lambda *_: False
        self._cuts: list[tuple[int, int]] | None = [(self.source.position - 1, 0)]
        self._cut_size = size
        for _ in self:
            pass
        cuts = self._cuts
        for (start, db), (end, _) in zip(cuts, cuts[1:]):
            if end > start:
                yield start, end, db

    def _read_header(self) -> Header:
        head = self.source.take(9)
        # The two magics and the versions they come with.
        for magic, prefix, versions in (("REDIS", b"REDIS0", range(1, 12)), ("VALKEY", b"VALKEY", (80,))):
            if head.startswith(prefix):
                digits = head[6:]
                if not digits.isdigit():
                    raise InvalidMagic(f"no version: {head!r}")
                if int(digits) not in versions:
                    raise UnsupportedVersion(f"{magic} version {int(digits)}")
                return Header(magic, int(digits))
        raise InvalidMagic(f"not a snapshot: {head!r}")

    def _read_aux(self) -> None:
        key, value = self.source.string(), self.source.string()
        try:
            name = key.decode()
        except UnicodeDecodeError:
            raise CorruptData("metadata name isn't UTF-8") from None
        self.header.aux[name] = value.decode("utf-8", "replace")

    def __iter__(self) -> Iterator[Entry]:
        s = self.source
        db, expiry, idle, freq = self.db, None, None, None
        cuts = getattr(self, "_cuts", None)
        while True:
            if self.end is not None and s.position >= self.end:
                return
            op = s.byte() if self._ahead is None else self._ahead
            self._ahead = None
            if op == N.OP_EXPIRETIME_MS:
                expiry = int.from_bytes(s.take(8), "little", signed=True)
            elif op in N.TYPES:
                now = (expiry, idle, freq)
                expiry = idle = freq = None  # also an entry that is skipped uses them up
                key = s.string()
                if op == N.MODULE_PRE_GA:
                    raise CorruptData("module values of the first format can't be read")
                if self.wanted is not None and not self.wanted(db, key, op):
                    self._skip(op)
                    self.skipped_unknown += op == N.HASH_ZIPMAP
                    if cuts is not None and s.position - cuts[-1][0] >= self._cut_size:
                        cuts.append((s.position, db))
                    continue
                if self.shallow and N.TYPES[op][0] in N.SHALLOW and op != N.HASH_ZIPMAP:
                    self._skip(op)
                    yield Entry(db, key, op, *now, None)
                    continue
                if op in N.PLAIN:
                    yield from self._chunks(db, key, op, *now)
                    continue
                try:
                    value = self._packed(op)
                except UnknownType:
                    self.skipped_unknown += 1
                else:
                    yield Entry(db, key, op, *now, value)
            elif op == N.OP_SELECTDB:
                db = s.length()
                if db > 0xFFFFFFFF:
                    raise CorruptData(f"database number {db}")
            elif op == N.OP_RESIZEDB:
                s.length(), s.length()
            elif op == N.OP_IDLE:
                idle = s.length()
            elif op == N.OP_FREQ:
                freq = s.byte()
            elif op == N.OP_EXPIRETIME:
                expiry = int.from_bytes(s.take(4), "little", signed=True) * 1000
            elif op == N.OP_EOF:
                if cuts is not None:
                    cuts.append((s.position - 1, db))
                self._finish()
                return
            elif op == N.OP_AUX:
                self._read_aux()
            elif op == N.OP_FUNCTION2:
                s.skip_string()
            elif op == N.OP_MODULE_AUX:
                s.length(), s.length(), s.length()
                read_module_values(s, keep=False)
            elif op == N.OP_SLOT_INFO:
                s.length(), s.length(), s.length()
            elif op == N.OP_SLOT_IMPORT:
                s.skip_string()
                for _ in range(s.length()):
                    s.length(), s.length()
            elif op == N.OP_FUNCTION_PRE_GA:
                raise CorruptData("functions of the first format can't be read")
            else:
                raise CorruptData(f"unknown opcode {op}")

    def _finish(self) -> None:
        actual = self.source.code_so_far() if self.verify else 0
        try:
            stored = int.from_bytes(self.source.take(8), "little")
        except Truncated:
            if self.header.version < 5:  # such files have no trailer
                return
            raise
        if self.verify and self.header.version >= 5 and stored:
            self.crc_checked = True
            if stored != actual:
                raise CorruptData(f"checksum {actual:#018x}, stored {stored:#018x}")

    def _elements(self, code: int, n: int) -> list:
        s = self.source
        string = s.string
        if code in (N.LIST, N.SET):
            return [string() for _ in range(n)]
        if code == N.HASH:
            return [(string(), string(), None) for _ in range(n)]
        if code == N.ZSET_2:
            double = s.double
            return [(string(), double()) for _ in range(n)]
        if code == N.ZSET:
            return [(string(), s.text_double()) for _ in range(n)]
        out = []
        for _ in range(n):  # hash with field expiry
            f, v = string(), string()
            at = int.from_bytes(s.take(8), "little", signed=True)
            out.append((f, v, None if at == -1 else at))
        return out

    def _chunks(self, db: int, key: bytes, code: int, expiry, idle, freq) -> Iterator[Entry]:
        n = self.source.count()
        step = self.chunk or max(n, 1)
        if n <= step:
            yield Entry(db, key, code, expiry, idle, freq, self._elements(code, n))
        else:
            for at in range(0, n, step):
                yield Entry(db, key, code, expiry, idle, freq, self._elements(code, min(step, n - at)), n, at)

    def _packed(self, code: int):
        s = self.source
        if code == N.STRING:
            return s.string()
        if self.keep_packed and code in (N.HASH_LISTPACK, N.SET_LISTPACK):
            return Packed([s.string()])
        if code in (N.HASH_LISTPACK, N.HASH_ZIPLIST):
            return field_pairs((listpack if code == N.HASH_LISTPACK else ziplist)(s.string()))
        if code in (N.ZSET_LISTPACK, N.ZSET_ZIPLIST):
            return scored_pairs((listpack if code == N.ZSET_LISTPACK else ziplist)(s.string(), numbers=True))
        if code == N.SET_LISTPACK:
            return listpack(s.string())
        if code == N.SET_INTSET:
            return intset(s.string())
        if code == N.LIST_ZIPLIST:
            return ziplist(s.string())
        if code == N.LIST_QUICKLIST:
            return [x for _ in range(s.count()) for x in ziplist(s.string())]
        if code == N.LIST_QUICKLIST_2:
            nodes = []
            for _ in range(s.count()):
                container = s.length()
                if container not in (1, 2):
                    raise CorruptData(f"list: unknown container {container}")
                nodes.append((container, s.string()))
            if self.keep_packed and all(container == 2 for container, _ in nodes):
                return Packed([blob for _, blob in nodes])
            return [x for container, blob in nodes for x in ((blob,) if container == 1 else listpack(blob))]
        if code in (N.STREAM_1, N.STREAM_2, N.STREAM_3):
            return read_stream(s, code)
        if code == N.MODULE_2:
            name, version = module_name(s.length())
            return name, version, read_module_values(s, keep=True)
        s.skip_string()
        raise UnknownType(f"type {code}")

    def _skip(self, code: int) -> None:
        """Pass over a value without decoding it; damage within packed blobs then goes unseen, but for the checksum."""
        s = self.source
        if code in (N.LIST, N.SET):
            for _ in range(s.count()):
                s.skip_string()
        elif code in (N.HASH, N.HASH_2, N.ZSET, N.ZSET_2):
            for _ in range(s.count()):
                s.skip_string()
                if code in (N.HASH, N.HASH_2):
                    s.skip_string()
                if code == N.ZSET:
                    s.text_double()
                elif code != N.HASH:
                    s.take(8)
        elif code == N.LIST_QUICKLIST:
            for _ in range(s.count()):
                s.skip_string()
        elif code == N.LIST_QUICKLIST_2:
            for _ in range(s.count()):
                s.length()
                s.skip_string()
        elif code in (N.STREAM_1, N.STREAM_2, N.STREAM_3):
            read_stream(s, code, skip=True)
        elif code == N.MODULE_2:
            s.length()
            read_module_values(s, keep=False)
        else:
            s.skip_string()

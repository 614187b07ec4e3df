"""Spark data sources over snapshot files: `kvsnapshot` gives entries, `kvsnapshot_info` a row per file.

    spark.dataSource.register(SnapshotSource)
    spark.read.format("kvsnapshot").load("dumps/*.rdb")

Options: path (a file, folder or glob; several separated by commas), maxKeyElements (50000), chunking (true),
verifyCrc (true), batchRows (65536), batchBytes (64 MiB), and db, types, keyPattern, which skip values before they are
decoded, and shallow, with which only strings and sorted sets have values. They are options of one load and never pushed down, as a pushed filter would stay with the source's later reads.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..codec import names as N
from ..codec.batches import Packed, listpacks
from ..codec.errors import CorruptData, SnapshotError, Unreadable
from ..codec.reader import Entry, SnapshotReader
from ..functions.columns import glob_regex
from ..functions.schemas import ENTRIES, INFO, parse_types
from .parquetblocks import open_fs

#: Families of codes that a type may come from.
SOURCES_OF = {"hyperloglog": "string", "geo": "zset"}


def open_snapshot(path: str):
    try:
        filesystem, name = open_fs(path)
        return filesystem.open_input_stream(name)
    except OSError as e:
        raise Unreadable(f"{path}: {e}") from None


def list_snapshots(path: str) -> list[str]:
    """The files of a path, folder or glob, sorted; of several, separated by commas, in their order."""
    out = []
    for one in path.split(","):
        filesystem, name = open_fs(one.strip())
        scheme = one.strip()[: len(one.strip()) - len(name)] if one.strip().endswith(name) else ""
        if any(c in name for c in "*?["):
            base = re.split(r"[*?\[]", name, maxsplit=1)[0].rpartition("/")[0] or "."
            pattern, _ = glob_regex(name)
            found = [f.path for f in filesystem.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File and re.match(pattern.replace(r"\z", r"\Z"), f.path)]
        else:
            info = filesystem.get_file_info(name)
            if info.type == pafs.FileType.Directory:
                found = [f.path for f in filesystem.get_file_info(pafs.FileSelector(name, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
            elif info.type == pafs.FileType.File:
                found = [name]
            else:
                found = []
        if not found:
            raise Unreadable(f"{one}: no such snapshot")
        out += [scheme + f for f in sorted(found)]
    return out


def parse_options(options: dict) -> dict:
    low = {k.lower(): v for k, v in options.items()}
    chunking = low.get("chunking", "true").lower() != "false"
    db, types, pattern = low.get("db"), parse_types(low.get("types")), low.get("keypattern")
    n = int(low.get("maxkeyelements", N.DEFAULT_CHUNK))
    if n < 1:
        raise ValueError("maxKeyElements must be 1 or more")
    return {
        "chunk": n if chunking else None, "verify": low.get("verifycrc", "true").lower() != "false",
        "rows": int(low.get("batchrows", 65_536)), "bytes": int(low.get("batchbytes", 64 << 20)),
        "db": None if db is None else int(db), "types": types, "pattern": pattern, "shallow": low.get("shallow", "false").lower() == "true",
    }


def wanted_by(o: dict):
    """The test of (db, key, code) that the options ask for, or None."""
    if o["db"] is None and o["types"] is None and o["pattern"] is None:
        return None
    families = None if o["types"] is None else {SOURCES_OF.get(t, t) for t in o["types"]}
    expression = negated = None
    if o["pattern"] is not None:
        text, negated = glob_regex(o["pattern"])
        expression = re.compile(text.replace(r"\z", r"\Z"))

    def wanted(db: int, key: bytes, code: int) -> bool:
        if o["db"] is not None and db != o["db"]:
            return False
        if families is not None and N.TYPES[code][0] not in families:
            return False
        return expression is None or bool(expression.match(key.decode("utf-8", "replace"))) != negated

    return wanted


def _u64(values: Sequence[int | None]) -> pa.Array:
    return pa.array([None if v is None else Decimal(v) for v in values], pa.decimal128(20, 0))


def _lists(n: int, rows: list[int], sizes: list[int], values: pa.Array) -> pa.Array:
    """A list column of n rows that is null but in `rows`, whose lists of `sizes` lie one after the other in values."""
    offsets, absent = np.zeros(n + 1, dtype=np.int32), np.ones(n, dtype=bool)
    if rows:
        at = np.array(rows)
        offsets[at + 1] = sizes
        absent[at] = False
    return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), values, mask=pa.array(absent))


def _structs(rows: Iterable[tuple], fields: dict[str, pa.DataType | None]) -> pa.Array:
    """A struct column of tuples; a type of None is an unsigned 64-bit number."""
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.StructArray.from_arrays([_u64(c) if t is None else pa.array(c, t) for c, t in zip(columns, fields.values())], list(fields))


def _pairs(elements: pa.Array) -> pa.Array:
    """Fields and values that alternate, as structs without expiry."""
    at = np.arange(0, len(elements), 2)
    fields, values = elements.take(pa.array(at)), elements.take(pa.array(at + 1))
    return pa.StructArray.from_arrays([fields, values, pa.nulls(len(at), pa.int64())], ["field", "value", "expiry_ms"])


def _scattered(n: int, rows: list[int], values: list) -> list:
    out = [None] * n
    for r, v in zip(rows, values):
        out[r] = v
    return out


NAMES = [f.name for f in ENTRIES.fields]
BINARY, TEXT, LONG, DOUBLE = pa.binary(), pa.string(), pa.int64(), pa.float64()


class _Batch:
    """Entries until there are enough of them for an Arrow batch, which is then built column by column."""

    def __init__(self, file: str):
        self.file, self.entries, self.bytes = file, [], 0

    def add(self, e: Entry) -> None:
        self.entries.append(e)
        v = e.value
        if type(v) is bytes:
            self.bytes += len(e.key) + len(v) + 64
        elif v is None:  # passed over
            self.bytes += len(e.key) + 64
        elif type(v) is Packed:  # about three bytes of a batch for one that is packed
            self.bytes += len(e.key) + 64 + 3 * sum(map(len, v.nodes))
        elif type(v) is list:
            self.bytes += len(e.key) + 64 + 24 * len(v) + sum(map(_width, v))
        else:
            self.bytes += len(e.key) + 64 + _packed_bytes(v[2])

    def record_batch(self, first: int) -> pa.RecordBatch:
        db, key, code, expiry, idle, freq, value, total, offset = zip(*self.entries)
        n = len(code)
        kind, encoding = zip(*[N.TYPES[c] for c in code])
        of: dict[str, list[int]] = {}
        for i, k in enumerate(kind):
            if value[i] is not None:
                of.setdefault("elems" if k in ("list", "set") else k, []).append(i)

        def nested(name: str) -> tuple[list[int], list[int], Iterable]:
            rows = of.get(name, [])
            mine = [value[i] for i in rows]
            return rows, [len(v) for v in mine], chain.from_iterable(mine)

        def lists(name: str, make: Callable[[Iterable], pa.Array], unpacked: Callable[[pa.Array], pa.Array] | None = None) -> pa.Array:
            packed = [i for i in of.get(name, []) if type(value[i]) is Packed]
            if not packed:
                rows, sizes, items = nested(name)
                return _lists(n, rows, sizes, make(items))
            of[name] = [i for i in of[name] if type(value[i]) is not Packed]
            rows, sizes, items = nested(name)
            counts, elements = listpacks([b for i in packed for b in value[i].nodes])
            per_node = np.repeat(np.arange(len(packed)), [len(value[i].nodes) for i in packed])
            counts = np.bincount(per_node, counts, len(packed)).astype(np.int64)
            if name == "hash":
                if (counts % 2).any():
                    raise CorruptData("hash: a field without value")
                counts //= 2
            apart = pa.concat_arrays([_lists(len(packed), list(range(len(packed))), counts.tolist(), unpacked(elements)), _lists(len(rows), list(range(len(rows))), sizes, make(items))])
            order = np.full(n, -1, dtype=np.int64)  # each row's place there, or none
            order[packed + rows] = np.arange(len(packed) + len(rows))
            return apart.take(pa.array(order, mask=order < 0))

        arrays = [
            pa.array([self.file] * n, TEXT), pa.array(range(first, first + n), LONG), pa.array(db, LONG), pa.array(key, BINARY), pa.array(code, pa.int16()), pa.array(kind, TEXT), pa.array(encoding, TEXT),
            pa.array(expiry, LONG), _u64(idle), pa.array(freq, pa.int16()), pa.array(total, LONG), pa.array(offset, LONG), pa.array([v if type(v) is bytes else None for v in value], BINARY),
            lists("elems", lambda items: pa.array(list(items), BINARY), lambda elements: elements),
            lists("zset", lambda items: _structs(items, {"member": BINARY, "score": DOUBLE})),
            lists("hash", lambda items: _structs(items, {"field": BINARY, "value": BINARY, "expiry_ms": LONG}), _pairs),
            self._modules(n, of.get("module", []), value), self._streams(n, of.get("stream", []), value),
        ]
        self.entries, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, NAMES)

    @staticmethod
    def _modules(n: int, rows: list[int], value: tuple) -> pa.Array:
        mine = [value[i] for i in rows]
        values = _structs(chain.from_iterable(v for _, _, v in mine), {"opcode": TEXT, "int_value": None, "double_value": DOUBLE, "string_value": BINARY})
        names, versions = (_scattered(n, rows, [v[k] for v in mine]) for k in (0, 1))
        columns = [pa.array(names, TEXT), pa.array(versions, LONG), _lists(n, rows, [len(v) for _, _, v in mine], values)]
        return pa.StructArray.from_arrays(columns, ["name", "version", "values"], mask=pa.array([x is None for x in names], pa.bool_()))

    @staticmethod
    def _streams(n: int, rows: list[int], value: tuple) -> pa.Array:
        mine = [value[i] for i in rows]
        logs = [e for _, _, entries in mine for e in entries]
        pairs = _structs(chain.from_iterable(f for _, f in logs), {"field": BINARY, "value": BINARY})
        fields = _lists(len(logs), list(range(len(logs))), [len(f) for _, f in logs], pairs)
        entries = pa.StructArray.from_arrays([pa.array([i for i, _ in logs], TEXT), fields], ["id", "fields"])
        lengths, lasts = (_scattered(n, rows, [v[k] for v in mine]) for k in (0, 1))
        columns = [_u64(lengths), pa.array(lasts, TEXT), _lists(n, rows, [len(e) for _, _, e in mine], entries)]
        return pa.StructArray.from_arrays(columns, ["length", "last_id", "entries"], mask=pa.array([x is None for x in lasts], pa.bool_()))


def _width(item: bytes | tuple) -> int:
    """Bytes of an element, of a member, or of a field with its value."""
    if type(item) is bytes:
        return len(item)
    return len(item[0]) + (len(item[1]) if type(item[1]) is bytes else 0)


def _packed_bytes(items: list) -> int:
    """Bytes of a module's values or a stream's entries."""
    return sum(32 + (sum(len(f) + len(v) + 16 for f, v in x[1]) if len(x) == 2 else len(x[3] or b"")) for x in items)


def larger_files(path: str, size: int) -> tuple[list[str], list[str]]:
    """The files of a path that have more than size bytes, and the others."""
    big, small = [], []
    for file in list_snapshots(path):
        filesystem, name = open_fs(file)
        (big if filesystem.get_file_info(name).size > size else small).append(file)
    return big, small


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def read_batches(path: str, o: dict) -> Iterator[pa.RecordBatch]:
    """Arrow batches of one file's entries."""
    try:
        with open_snapshot(path) as raw:
            reader = SnapshotReader(raw, o["chunk"], o["verify"], wanted_by(o), o["shallow"], True)
            yield from _batched(path, reader, o, 0)
    except SnapshotError as e:
        raise _of_file(path, e) from None
    except OSError as e:
        raise Unreadable(f"{path}: {e}") from None


#: Entries that one part of a file may have; seq is part * PART_ENTRIES + place in the part.
PART_ENTRIES = 1 << 40


def _of_file(path: str, e: SnapshotError) -> SnapshotError:
    tag, _, text = e.args[0].partition(" ")
    return type(e)(f"{tag} {path}: {text}")


def _batched(path: str, reader: SnapshotReader, o: dict, first: int) -> Iterator[pa.RecordBatch]:
    batch = _Batch(path)
    collecting = gc.isenabled()
    gc.disable()  # entries hold no cycles, but there are so many that looking for some costs a fifth of the time
    try:
        for entry in reader:
            batch.add(entry)
            if len(batch.entries) >= o["rows"] or batch.bytes >= o["bytes"]:
                n = len(batch.entries)
                yield batch.record_batch(first)
                first += n
        if batch.entries:
            yield batch.record_batch(first)
    finally:
        if collecting:
            gc.enable()


def find_parts(path: str, size: int, verify: bool = True) -> list[tuple[int, int, int, int]]:
    """(part, start, end, db) of one file."""
    try:
        with open_snapshot(path) as raw:
            return [(i, *p) for i, p in enumerate(SnapshotReader(raw, verify_crc=verify).parts(size))]
    except SnapshotError as e:
        raise _of_file(path, e) from None


def read_part(path: str, part: int, start: int, end: int, db: int, o: dict) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the entries of one part."""
    try:
        filesystem, name = open_fs(path)
        with filesystem.open_input_file(name) as raw:
            raw.seek(start)
            yield from _batched(path, SnapshotReader.of_part(raw, start, end, db, o["chunk"], wanted_by(o), o["shallow"], True), o, part * PART_ENTRIES)
    except SnapshotError as e:
        raise _of_file(path, e) from None
    except OSError as e:
        raise Unreadable(f"{path}: {e}") from None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        if "path" not in low:
            raise ValueError("a path is needed")
        self.path, self.o = low["path"], parse_options(options)

    def partitions(self):
        return [FilePartition(p) for p in list_snapshots(self.path)]


class EntryReader(_Reader):
    def read(self, partition):
        yield from read_batches(partition.path, self.o)


class InfoReader(_Reader):
    """Header and metadata; with drain (the default) the whole file is read, so that its checksum is compared."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.drain = {k.lower(): v for k, v in options.items()}.get("drain", "true").lower() != "false"

    def read(self, partition):
        try:
            with open_snapshot(partition.path) as raw:
                reader = SnapshotReader(raw, self.o["chunk"], self.o["verify"], wanted=lambda *_: False)
                if self.drain:
                    for _ in reader:
                        pass
                h = reader.header
                u = lambda n: None if n is None else Decimal(n)
                yield (partition.path, h.magic, h.version, dict(sorted(h.aux.items())), h.server_version, u(h.ctime), u(h.used_mem), h.repl_id, h.repl_offset, reader.skipped_unknown, reader.crc_checked)
        except SnapshotError as e:
            raise _of_file(partition.path, e) from None
        except OSError as e:
            raise Unreadable(f"{partition.path}: {e}") from None


class SnapshotSource(DataSource):
    @classmethod
    def name(cls):
        return "kvsnapshot"

    def schema(self):
        return ENTRIES

    def reader(self, schema):
        return EntryReader(dict(self.options))


class SnapshotInfoSource(DataSource):
    @classmethod
    def name(cls):
        return "kvsnapshot_info"

    def schema(self):
        return INFO

    def reader(self, schema):
        return InfoReader(dict(self.options))

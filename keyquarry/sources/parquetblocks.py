"""Join Parquet files by copying their encoded column blocks and writing a new footer; no value is decoded."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs

from . import thriftcompact as tc
from .parquetpages import COLUMN_DATA, COLUMN_DICTIONARY, COLUMN_PLAIN_SIZE, COLUMN_SIZE, GroupMerger

MAGIC = b"PAR1"
COPY_BYTES = 8 << 20
#: Threads that open files ahead of the one that is being copied, so many at a time; those of up to AHEAD_BYTES are read.
READERS, AHEAD_FILES, AHEAD_BYTES = 4, 32, 256 << 10
#: Row groups of less are merged, into groups of about so many bytes, or rows. A group costs a reader as much as some
#: 30 KiB do, so that of larger ones reading gains nothing by merging.
SMALL_BYTES, GROUP_BYTES, MOST_ROWS = 128 << 10, 64 << 20, 1 << 20

# Field ids of the Parquet footer's structures.
META_VERSION, META_SCHEMA, META_ROWS, META_GROUPS, META_KEY_VALUE, META_ORDERS, META_ENCRYPTION = 1, 2, 3, 4, 5, 7, 8
GROUP_COLUMNS, GROUP_PLAIN_SIZE, GROUP_ROWS, GROUP_OFFSET, GROUP_SIZE, GROUP_ORDINAL = 1, 2, 3, 5, 6, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META, CHUNK_INDEXES = 1, 2, 3, (4, 5, 6, 7)
COLUMN_INDEX, COLUMN_BLOOM = 10, (14, 15)


class IncompatibleBlocks(ValueError):
    """A file can't be copied block by block, or what was written doesn't add up."""


@dataclass
class Footer:
    meta: dict
    length: int
    schema: bytes  # as the footer has it, encoded

    @property
    def rows(self) -> int:
        return self.meta[META_ROWS][1]

    @property
    def groups(self) -> list[dict]:
        return self.meta[META_GROUPS][1][1]

    @property
    def signature(self) -> str:
        """Equal for files whose blocks may stand in one file: same schema and sort orders of columns."""
        orders = tc.struct_bytes({META_ORDERS: self.meta[META_ORDERS]}) if META_ORDERS in self.meta else b""
        return hashlib.sha1(self.schema + orders).hexdigest()

    @property
    def key_values(self) -> dict[bytes, bytes | None]:
        if META_KEY_VALUE not in self.meta:
            return {}
        return {kv[1][1]: kv[2][1] if 2 in kv else None for kv in self.meta[META_KEY_VALUE][1][1]}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_footer(f, path: str) -> Footer:
    size = f.size()
    if size < 12:
        raise IncompatibleBlocks(f"{path}: too short for a Parquet file")
    f.seek(size - 8)
    n, magic = struct.unpack("<I4s", f.read(8))
    if magic != MAGIC or n + 12 > size:
        raise IncompatibleBlocks(f"{path}: no plain Parquet footer")
    f.seek(size - 8 - n)
    meta, schema = _parse_footer(f.read(n))
    if META_ENCRYPTION in meta:
        raise IncompatibleBlocks(f"{path}: encrypted")
    return Footer(meta, n, schema)


#: Beginnings of footers, up to the schema's end, that were parsed before: many small files have the same.
_beginnings: dict[bytes, dict] = {}
BEGINNINGS = 16


def _parse_footer(raw: bytes) -> tuple[dict, bytes]:
    """A footer's fields and its encoded schema."""
    for begin, fields in list(_beginnings.items()):
        if raw.startswith(begin):
            return fields | tc.read_struct(raw, len(begin), META_SCHEMA)[0], begin
    meta, _ = tc.read_struct(raw)
    schema = {k: meta[k] for k in (META_VERSION, META_SCHEMA) if k in meta}
    begin = tc.struct_bytes(schema)[:-1]
    if raw.startswith(begin):  # as every writer encodes it
        if len(_beginnings) >= BEGINNINGS:
            _beginnings.pop(next(iter(_beginnings)))
        _beginnings[begin] = schema
    return meta, begin


def footer_facts(path: str) -> tuple[str, int, int]:
    """(signature, blocks, rows) of one file."""
    filesystem, name = open_fs(path)
    with filesystem.open_input_file(name) as f:
        footer = read_footer(f, path)
    if sum(g[GROUP_ROWS][1] for g in footer.groups) != footer.rows:
        raise IncompatibleBlocks(f"{path}: the rows of its blocks don't add up to the file's")
    return footer.signature, len(footer.groups), footer.rows


def footers_facts(paths: list[str]) -> list[tuple[str, int, int]]:
    """footer_facts of several files; while one waits for its storage, others are read."""
    with ThreadPoolExecutor(READERS) as pool:
        return list(pool.map(footer_facts, paths))


def _open_ahead(paths: list[str]) -> list[pa.NativeFile]:
    """Files to read from; small ones are read at once, so that they can be read before their turn."""
    out = []
    for path in paths:
        filesystem, name = open_fs(path)
        f = filesystem.open_input_file(name)
        if f.size() <= AHEAD_BYTES:
            with f:
                out.append(pa.BufferReader(f.read()))
        else:
            out.append(f)
    return out


def opened(paths: list[str]) -> Iterator[tuple[str, pa.NativeFile]]:
    """(path, open file) one after the other, with READERS times AHEAD_FILES files opened ahead."""
    groups = [paths[i : i + AHEAD_FILES] for i in range(0, len(paths), AHEAD_FILES)]
    with ThreadPoolExecutor(READERS) as pool:
        waiting: deque = deque()
        for at in range(len(groups) + READERS):
            if at < len(groups):
                waiting.append((groups[at], pool.submit(_open_ahead, groups[at])))
            if waiting and (at >= READERS or at >= len(groups)):
                group, ahead = waiting.popleft()
                for path, f in zip(group, ahead.result()):
                    with f:
                        yield path, f


def _copy(source, sink, start: int, size: int) -> None:
    source.seek(start)
    while size:
        part = source.read(min(COPY_BYTES, size))
        if not part:
            raise IncompatibleBlocks("a block ends before its stated size")
        sink.write(part)
        size -= len(part)


class _Joined:
    """The file that is being written: groups copied as they are, and small ones merged."""

    def __init__(self, sink, small_bytes: int, group_bytes: int, group_rows: int):
        self.sink, self.at, self.groups = sink, 4, []
        self.small_bytes, self.group_bytes, self.group_rows = small_bytes, group_bytes, group_rows
        self.merger: GroupMerger | None = None
        self.merging: tuple | None = None

    def add(self, source, footer: Footer, path: str) -> None:
        for group in footer.groups:
            metas, starts = [], []
            for chunk in group[GROUP_COLUMNS][1][1]:
                if CHUNK_PATH in chunk or CHUNK_META not in chunk:
                    raise IncompatibleBlocks(f"{path}: a column lies outside the file")
                meta = chunk[CHUNK_META][1]
                metas.append(meta)
                # Pages lie one after the other, the dictionary first; a block without rows may lack either.
                starts.append(min((x for x in (meta.get(COLUMN_DICTIONARY, (0, 0))[1], meta[COLUMN_DATA][1]) if x > 0), default=0))
            codecs = GroupMerger.codecs(metas)
            if codecs is None or sum(m[COLUMN_SIZE][1] for m in metas) >= self.small_bytes:
                self._copied(source, group, metas, starts)
                continue
            if self.merging != codecs:
                self.flush()
                self.merger, self.merging = GroupMerger(footer.meta[META_SCHEMA][1][1], metas), codecs
            chunks = []
            for meta, start in zip(metas, starts):
                source.seek(start)
                chunks.append((source.read(meta[COLUMN_SIZE][1]), meta))
            try:
                self.merger.add(group[GROUP_ROWS][1], chunks)
            except (ValueError, KeyError, IndexError) as e:
                raise IncompatibleBlocks(f"{path}: {e!r}") from None
            if self.merger.rows >= self.group_rows or self.merger.bytes >= self.group_bytes:
                self.flush()

    def _copied(self, source, group: dict, metas: list[dict], starts: list[int]) -> None:
        group, group_at, moved = dict(group), self.at, []
        element, chunks = group[GROUP_COLUMNS][1]
        for chunk, meta, start in zip(chunks, metas, starts):
            meta = dict(meta)
            size = meta[COLUMN_SIZE][1]
            _copy(source, self.sink, start, size)
            for k in (COLUMN_DATA, COLUMN_INDEX, COLUMN_DICTIONARY):
                if k in meta and meta[k][1] > 0:
                    meta[k] = (meta[k][0], meta[k][1] - start + self.at)
            for k in COLUMN_BLOOM:
                meta.pop(k, None)
            chunk = {k: v for k, v in chunk.items() if k not in CHUNK_INDEXES}
            moved.append(chunk | {CHUNK_OFFSET: (tc.I64, self.at), CHUNK_META: (tc.STRUCT, meta)})
            self.at += size
        group[GROUP_COLUMNS] = (tc.LIST, (element, moved))
        if GROUP_OFFSET in group:
            group[GROUP_OFFSET] = (tc.I64, group_at)
        group.pop(GROUP_ORDINAL, None)
        self.groups.append(group)

    def flush(self) -> None:
        """Write the merged group."""
        if self.merger is None or not self.merger.rows:
            self.merger = self.merging = None
            return
        group_at, columns, plain = self.at, [], 0
        for parts, meta in self.merger.close(self.at):
            columns.append({CHUNK_OFFSET: (tc.I64, self.at), CHUNK_META: (tc.STRUCT, meta)})
            for part in parts:
                self.sink.write(part)
            self.at += meta[COLUMN_SIZE][1]
            plain += meta[COLUMN_PLAIN_SIZE][1]
        self.groups.append({GROUP_COLUMNS: (tc.LIST, (tc.STRUCT, columns)), GROUP_PLAIN_SIZE: (tc.I64, plain), GROUP_ROWS: (tc.I64, self.merger.rows), GROUP_OFFSET: (tc.I64, group_at), GROUP_SIZE: (tc.I64, self.at - group_at)})
        self.merger = self.merging = None


def join_files(paths: list[str], target: str, small_bytes: int = SMALL_BYTES, group_bytes: int = GROUP_BYTES, group_rows: int = MOST_ROWS) -> tuple[int, int, int, int]:
    """Join paths into target; returns (blocks read, groups written, rows, bytes).

    A row group of small_bytes or more is copied as it is. Smaller ones are merged, page by page (parquetpages), into
    groups of about group_bytes, or group_rows; rows of merged groups keep their order among each other. With small_bytes
    0 every group is copied. So is a small group whose codec isn't known here (LZO, and LZ4 of old writers). Groups
    without rows are left out when they are merged.

    Column and offset indexes and Bloom filters, which lie outside the blocks, are left out. Key-value metadata stays
    where no two files contradict. The file is written under another name and renamed when its footer, read again,
    has the stated schema, group count and rows, so a lost or repeated task leaves no half file.
    """
    out_fs, out_name = open_fs(target)
    temporary = f"{out_name}.{uuid.uuid4().hex}.part"
    blocks, rows, kept, clash, first = 0, 0, {}, set(), None
    with out_fs.open_output_stream(temporary) as sink:
        sink.write(MAGIC)
        joined = _Joined(sink, small_bytes, group_bytes, group_rows)
        for path, source in opened(paths):
            footer = read_footer(source, path)
            if first is None:
                first = footer
            if footer.signature != first.signature:
                raise IncompatibleBlocks(f"{path}: its schema differs from that of {paths[0]}")
            if sum(g[GROUP_ROWS][1] for g in footer.groups) != footer.rows:
                raise IncompatibleBlocks(f"{path}: the rows of its blocks don't add up to the file's")
            for k, v in footer.key_values.items():
                if kept.setdefault(k, v) != v:
                    clash.add(k)
            joined.add(source, footer, path)
            blocks += len(footer.groups)
            rows += footer.rows
        joined.flush()
        meta = dict(first.meta)
        meta[META_ROWS] = (tc.I64, rows)
        meta[META_GROUPS] = (tc.LIST, (tc.STRUCT, joined.groups))
        pairs = [{1: (tc.BINARY, k)} | ({2: (tc.BINARY, v)} if v is not None else {}) for k, v in kept.items() if k not in clash]
        meta.pop(META_KEY_VALUE, None)
        if pairs:
            meta[META_KEY_VALUE] = (tc.LIST, (tc.STRUCT, pairs))
        tail = tc.struct_bytes(meta)
        sink.write(tail + struct.pack("<I", len(tail)) + MAGIC)
    with out_fs.open_input_file(temporary) as f:
        size, written = f.size(), read_footer(f, target)
    sound = size == joined.at + len(tail) + 8 and written.signature == first.signature and len(written.groups) == len(joined.groups)
    if not sound or written.rows != rows or sum(g[GROUP_ROWS][1] for g in written.groups) != rows:
        out_fs.delete_file(temporary)
        raise IncompatibleBlocks(f"{target}: what was written isn't what was read")
    out_fs.move(temporary, out_name)
    return blocks, len(joined.groups), rows, size

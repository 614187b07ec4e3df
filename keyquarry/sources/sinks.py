"""Exports of tables: Parquet, Arrow IPC, CSV and JSON lines, a folder per type named {type}{.shard}.{extension}."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schemas import HEURISTICS, TYPES, arrow_schema, format_heuristics
from ..operators.tables import select_entries, tables
from .parquetblocks import open_fs

TOOL = "keyquarry 0.1.0"
#: Codecs by the names that are accepted, and extensions by format.
CODECS = {"zstd": "zstd", "snappy": "snappy", "lz4": "lz4", "lz4-raw": "lz4_raw", "lz4_raw": "lz4_raw", "gzip": "gzip", "none": "none"}
EXTENSIONS = {"parquet": "parquet", "arrow-ipc": "arrow", "csv": "csv", "json": "json"}
#: Rows of a Parquet row group, and the bytes that close one before it has so many.
DEFAULT_ROW_GROUP, GROUP_BYTES = 1_048_576, 256 << 20


def parse_compression(name: str) -> str:
    if name.lower() not in CODECS:
        raise ValueError(f"unknown compression {name!r}; known: {', '.join(CODECS)}")
    return CODECS[name.lower()]


def export_metadata(aux: dict[str, str], heuristics: frozenset[str]) -> dict[str, str]:
    """What an export says of its origin: every metadata field of the snapshot, the tool, and the heuristics."""
    return {f"rdb.{k}": v for k, v in sorted(aux.items())} | {"rdb.exported_by": TOOL, "rdb.heuristics": format_heuristics(heuristics)}


def hexed(df: DataFrame) -> DataFrame:
    """Binary columns as lower-case hex, for text formats."""
    return df.select(*[F.lower(F.hex(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema.fields])


def exported(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """A table's batch in the types of its export."""
    return pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)


def _arrow_files(df: DataFrame, folder: str, schema: pa.Schema, form: str, row_group: int, codec: str) -> int:
    """Write each partition as an Arrow IPC or Parquet file, and return the rows; row groups have row_group rows, or
    fewer where those take GROUP_BYTES.

    Tasks write under names of their own; those of the tasks that counted, one for each partition, then get their final
    names, and the others, of attempts that failed or were repeated, are deleted.
    """
    extension = EXTENSIONS[form]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, name = open_fs(folder)
        mine = f"_{uuid.uuid4().hex}.part"
        sink = writer = None
        rows, waiting, n, size = 0, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = filesystem.open_output_stream(f"{name}/{mine}")
                writer = pa.ipc.new_file(sink, schema) if form == "arrow-ipc" else pq.ParquetWriter(sink, schema, compression=codec)
            batch = exported(batch, schema)
            rows += batch.num_rows
            if form == "arrow-ipc":
                writer.write_batch(batch)
                continue
            waiting, n, size = [*waiting, batch], n + batch.num_rows, size + batch.nbytes
            if n >= row_group or size >= GROUP_BYTES:
                table = pa.Table.from_batches(waiting, schema)
                take = n if n < row_group else n // row_group * row_group
                writer.write_table(table.slice(0, take), row_group_size=row_group)
                rest = table.slice(take)
                waiting, n, size = rest.to_batches(), rest.num_rows, rest.nbytes
        if writer is not None:
            if n:
                writer.write_table(pa.Table.from_batches(waiting, schema), row_group_size=row_group)
            writer.close()
            sink.close()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([mine if rows else None], pa.string()), "rows": pa.array([rows], pa.int64())})

    filesystem, name = open_fs(folder)
    filesystem.create_dir(name, recursive=True)
    done = df.mapInArrow(write, "part int, file string, rows bigint").collect()  # a row per task
    for r in done:
        if r["file"]:
            filesystem.move(f"{name}/{r['file']}", f"{name}/part-{r['part']:05d}.{extension}")
    if not any(r["file"] for r in done):  # a table without rows is a file without rows
        with filesystem.open_output_stream(f"{name}/part-00000.{extension}") as sink:
            with pa.ipc.new_file(sink, schema) if form == "arrow-ipc" else pq.ParquetWriter(sink, schema, compression=codec):
                pass
    for left in filesystem.get_file_info(pafs.FileSelector(name)):
        if left.base_name.startswith("_"):
            filesystem.delete_file(left.path)
    return sum(r["rows"] for r in done)


def _move_folder(filesystem: pafs.FileSystem, source: str, target: str) -> None:
    """Rename a folder, or, where the storage knows no folders, move its files."""
    try:
        filesystem.move(source, target)
    except (OSError, NotImplementedError):
        filesystem.create_dir(target, recursive=True)
        for f in filesystem.get_file_info(pafs.FileSelector(source)):
            filesystem.move(f.path, f"{target}/{f.base_name}")


def write_table(df: DataFrame, folder: str, kind: str, form: str = "parquet", compression: str = "zstd", row_group_size: int | None = None, metadata: dict[str, str] | None = None, expected: int | None = None) -> None:
    """Write the table of a type; files of Parquet and Arrow IPC have its arrow_schema, with the metadata in the footer.

    Everything is written beside the folder and takes its place at the end, so a failed write leaves what was there. With
    `expected` that many rows must have been written (Parquet and Arrow IPC), else ValueError.
    """
    codec = parse_compression(compression)
    if form not in EXTENSIONS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(EXTENSIONS)}")
    filesystem, name = open_fs(folder.rstrip("/"))
    parent, _, base = folder.rstrip("/").rpartition("/")
    beside = f"{parent}/_{base}.{uuid.uuid4().hex}"
    aside = open_fs(beside)[1]
    try:
        if form in ("parquet", "arrow-ipc"):
            schema = arrow_schema(kind, metadata)
            rows = _arrow_files(df, beside, schema, form, row_group_size or DEFAULT_ROW_GROUP, "lz4" if codec == "lz4_raw" else codec)
            if expected is not None and rows != expected:
                raise ValueError(f"{folder}: {rows} rows written, {expected} expected")
        elif form == "csv":
            hexed(df).write.csv(beside, header=True)
        else:
            hexed(df).write.json(beside)
        if filesystem.get_file_info(name).type == pafs.FileType.Directory:
            filesystem.delete_dir(name)
        _move_folder(filesystem, aside, name)
    finally:
        if filesystem.get_file_info(aside).type == pafs.FileType.Directory:
            filesystem.delete_dir(aside)


class Exported(dict):
    """Rows written by type, and `skipped`: values of unknown types, and entries over the size limit."""

    def __init__(self, rows: dict[str, int], skipped: dict[str, int]):
        super().__init__(rows)
        self.skipped = skipped


def common_metadata(headers: list[dict[str, str]]) -> dict[str, str]:
    """The metadata fields that all of several snapshots have with one value."""
    first = headers[0] if headers else {}
    return {k: v for k, v in first.items() if all(h.get(k) == v for h in headers)}


def export(entries: DataFrame, out: str, form: str = "parquet", types: set[str] | None = None, heuristics: frozenset[str] = frozenset(HEURISTICS), compression: str = "zstd", row_group_size: int | None = None, shard: str | None = None, headers: dict[str, dict[str, str]] | None = None, max_entry_bytes: int | None = None, unknown: int = 0) -> Exported:
    """Write the tables of the types that occur (of those asked for) and return their rows by type.

    The entries are decoded once and kept on executors' disks while the tables are written. headers are the metadata of
    each snapshot; what they agree in is in every file's footer, all of it in the manifest beside the tables. A failed
    write leaves no part of its table, and an older one as it was.
    """
    if form not in EXTENSIONS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(EXTENSIONS)}")
    if shard is not None and not re.fullmatch(r"[A-Za-z0-9_-]+", shard):
        raise ValueError(f"shard {shard!r}: only letters, digits, _ and -")
    from ..operators.summary import skip_counts, type_counts  # summary reads exports, too

    metadata = export_metadata(common_metadata(list((headers or {}).values())), heuristics)
    kept = entries.persist(StorageLevel.DISK_ONLY)
    try:
        oversized = skip_counts(kept, max_entry_bytes).first()["oversized"] if max_entry_bytes is not None else 0
        some = select_entries(kept, max_entry_bytes=max_entry_bytes)
        seen = {r["type"]: r["rows"] for r in type_counts(some, heuristics).collect()}
        written = {}
        for kind, df in tables(some, types, heuristics).items():
            if kind in seen:
                write_table(df, f"{out}/{kind}{f'.{shard}' if shard else ''}.{EXTENSIONS[form]}", kind, form, compression, row_group_size, metadata, seen[kind])
                written[kind] = seen[kind]
    finally:
        kept.unpersist()
    skipped = {"unknown_type": unknown, "oversized": oversized}
    filesystem, name = open_fs(out)
    filesystem.create_dir(name, recursive=True)
    with filesystem.open_output_stream(f"{name}/_export_manifest{f'.{shard}' if shard else ''}.json") as f:
        f.write(json.dumps({"metadata": metadata, "snapshots": headers or {}, "format": form, "rows": {k: written[k] for k in TYPES if k in written}, "skipped": skipped}, indent=1).encode())
    return Exported(written, skipped)


def existing(out: str, form: str) -> list[str]:
    """What already lies in a folder with the format's extension."""
    filesystem, name = open_fs(out)
    found = filesystem.get_file_info(pafs.FileSelector(name, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(f".{EXTENSIONS[form]}"))

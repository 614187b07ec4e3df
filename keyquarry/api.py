"""Reading, exporting and inspecting snapshots from Python.

Errors: a file that can't be read or ends early is an OSError, one that isn't a sound snapshot, like a wrong argument, a
ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .codec.errors import SnapshotError, Truncated, Unreadable, from_message
from .functions.schemas import TYPES, arrow_schema, parse_heuristics, parse_types
from .operators import summary
from .operators.tables import PART_BYTES, read_entries, read_info, select_entries, table, tables
from .sources import sinks


class SnapshotIOError(OSError):
    """A file that ends early, or can't be read."""


class SnapshotUnreadableError(SnapshotIOError):
    pass


class SnapshotValueError(ValueError):
    pass


@contextmanager
def told():
    """Turns what a worker or the driver says of a snapshot into OSError or ValueError."""
    try:
        yield
    except Exception as e:  # of this module's own, of Spark, or of the JVM gateway
        known = e if isinstance(e, SnapshotError) else from_message(str(e))
        if known is None:
            raise
        kind = SnapshotUnreadableError if isinstance(known, Unreadable) else SnapshotIOError if isinstance(known, Truncated) else SnapshotValueError
        raise kind(str(known)) from None


def entries(spark: SparkSession, path: str, max_key_elements: int | None = None, chunking: bool = True, verify_crc: bool = True, db: int | None = None, types: str | None = None, key_pattern: str | None = None, batch_rows: int | None = None, batch_bytes: int | None = None, part_bytes: int | None = PART_BYTES, shallow: bool = False) -> DataFrame:
    """Entries of snapshots. db, types and key_pattern skip other values undecoded; shallow skips those that decide no
    type. Snapshots of more than part_bytes are read in parts (0 or None: each by one task)."""
    for name, n in (("max_key_elements", max_key_elements), ("batch_rows", batch_rows), ("batch_bytes", batch_bytes)):
        if n is not None and n < 1:
            raise ValueError(f"{name} must be 1 or more")
    with told():
        return read_entries(spark, path, part_bytes, maxKeyElements=max_key_elements, chunking=chunking, verifyCrc=verify_crc, db=db, types=types, keyPattern=key_pattern, batchRows=batch_rows, batchBytes=batch_bytes, shallow=shallow)


def read(spark: SparkSession, path: str, heuristic: str = "all", max_entry_bytes: int | None = None, types: str | None = None, **options) -> dict[str, DataFrame]:
    """The tables that occur in a snapshot, by type.

    Which do is found in a pass that decodes only what decides on types (all, if there is a limit of size); each table
    then decodes the values of its own type, and no others.
    """
    known, chosen = parse_heuristics(heuristic), parse_types(types)
    first = entries(spark, path, types=types, shallow=max_entry_bytes is None, **options)
    with told():
        seen = {r["type"] for r in summary.type_counts(select_entries(first, max_entry_bytes=max_entry_bytes, heuristics=known), known).collect()}
    out = {}
    for kind in TYPES:
        if kind in seen and (chosen is None or kind in chosen):
            mine = select_entries(entries(spark, path, types=kind, **options), max_entry_bytes=max_entry_bytes, heuristics=known)
            out[kind] = table(mine, kind, known)
    return out


def read_batches(spark: SparkSession, path: str, heuristic: str = "all", max_entry_bytes: int | None = None, types: str | None = None, **options) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(type, Arrow batch in the export's types) one after the other; the driver holds two partitions' batches at a time.
    The snapshot is decoded once and kept on executors' disks until the last batch is taken."""
    known, chosen = parse_heuristics(heuristic), parse_types(types)

    def pack(kind: str):
        schema = arrow_schema(kind)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, schema) as w:
                        w.write_batch(sinks.exported(b, schema))
                    yield pa.RecordBatch.from_pydict({"b": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        return packed

    kept = select_entries(entries(spark, path, types=types, **options), max_entry_bytes=max_entry_bytes, heuristics=known).persist(StorageLevel.DISK_ONLY)
    try:
        with told():
            seen = {r["type"] for r in summary.type_counts(kept, known).collect()}
        for kind, df in tables(kept, seen if chosen is None else seen & chosen, known).items():
            with told():
                for row in df.mapInArrow(pack(kind), "b binary").toLocalIterator(prefetchPartitions=True):
                    with pa.ipc.open_stream(bytes(row["b"])) as r:
                        for batch in r:
                            yield kind, batch
    finally:
        kept.unpersist()


def to_parquet(spark: SparkSession, path: str, out: str, compression: str = "zstd", row_group_size: int | None = None, heuristic: str = "all", max_entry_bytes: int | None = None, **options) -> sinks.Exported:
    """Export a snapshot to Parquet; returns the rows written by type."""
    return export(spark, path, out, "parquet", compression=compression, row_group_size=row_group_size, heuristic=heuristic, max_entry_bytes=max_entry_bytes, **options)


def export(spark: SparkSession, path: str, out: str, form: str = "parquet", compression: str = "zstd", row_group_size: int | None = None, heuristic: str = "all", max_entry_bytes: int | None = None, db: int | None = None, types: str | None = None, key_pattern: str | None = None, shard: str | None = None, **options) -> sinks.Exported:
    """Export snapshots; returns the rows written by type, with what was left out in `skipped`."""
    if row_group_size is not None and row_group_size < 1:
        raise ValueError("row_group_size must be 1 or more")
    sinks.parse_compression(compression)
    known, chosen = parse_heuristics(heuristic), parse_types(types)
    with told():
        # One pass without decoding tells of metadata and skipped values and compares the checksum; the next needn't.
        head = read_info(spark, path, verifyCrc=options.pop("verify_crc", None)).orderBy("file").select("file", "aux", "skipped_unknown").collect()  # a row per file
        found = entries(spark, path, db=db, types=types, key_pattern=key_pattern, verify_crc=False, **options)
        found = select_entries(found, db, chosen, key_pattern, None, known)
        return sinks.export(found, out, form, chosen, known, compression, row_group_size, shard, {r["file"]: r["aux"] for r in head}, max_entry_bytes, sum(r["skipped_unknown"] for r in head))


def inspect(spark: SparkSession, path: str, heuristic: str = "all", **options) -> dict:
    with told():
        return summary.inspect(spark, path, heuristic, **options)


def validate(spark: SparkSession, path: str, folder: str) -> list[dict]:
    """Types with keys, rows of both sides and status, in the types' order."""
    with told():
        rows = {r["type"]: r.asDict() for r in summary.validate(spark, path, folder).collect()}
    return [rows[t] for t in TYPES if t in rows]

"""The nine tables as plain projections of entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.schemas import ENTRIES, HEURISTICS, TYPES, U64, parse_types
from ..runtime import materialize, ship
from ..sources import snapshotfiles
from ..sources.snapshotfiles import SnapshotInfoSource, SnapshotSource


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SnapshotSource)
    spark.dataSource.register(SnapshotInfoSource)


#: Snapshots of more bytes are read in parts of so many.
PART_BYTES = 256 << 20


def read_entries(spark: SparkSession, path: str, partBytes: int | None = None, **options) -> DataFrame:
    """Entries of the snapshots at path; for options see sources.snapshotfiles.

    With partBytes, snapshots of more bytes are read in parts of about so many, in parallel: where they can be cut is
    found at once, in one pass over each of them that decodes nothing (find_parts), a task per file.
    """
    _register(spark)
    text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    whole = lambda p: spark.read.format("kvsnapshot").options(**text).load(p)
    if not partBytes:
        return whole(path)
    big, small = snapshotfiles.larger_files(path, partBytes)
    if not big:
        return whole(path)
    verify = text.get("verifyCrc", "true") != "false"
    apart = read_parts(find_parts(spark, ",".join(big), partBytes, verify), **options)
    return apart.unionByName(whole(",".join(small))) if small else apart


def read_info(spark: SparkSession, path: str, **options) -> DataFrame:
    """A row per snapshot: header, metadata, and, unless drain is false, skipped values and whether the CRC was compared."""
    _register(spark)
    return spark.read.format("kvsnapshot_info").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}).load(path)


def find_parts(spark: SparkSession, path: str, part_bytes: int = 256 << 20, verify_crc: bool = True) -> DataFrame:
    """(file, part, start, end, db): where large snapshots can be cut. One pass over each file, a task per file, which
    decodes nothing and compares the checksum; the result is written and serves any number of reads."""
    ship(spark)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *p) for f in batch["file"] for p in snapshotfiles.find_parts(f, part_bytes, verify_crc)]
            yield pd.DataFrame(rows, columns=["file", "part", "start", "end", "db"])

    files = snapshotfiles.list_snapshots(path)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))
    return materialize(listed.mapInPandas(find, "file string, part bigint, start bigint, end bigint, db bigint"), "parts")


def read_parts(parts: DataFrame, **options) -> DataFrame:
    """Entries of snapshots read part by part, about one part per task, with the options of read_entries. seq still
    orders a file's entries but isn't consecutive across parts. The checksum was compared when the parts were found."""
    o = snapshotfiles.parse_options({k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from snapshotfiles.read_part(r["file"], r["part"], r["start"], r["end"], r["db"], o)

    return parts.repartition(max(1, parts.count())).mapInArrow(read, ENTRIES)


def _common(kind: str, count: Column, encoding: str = "encoding") -> list[Column]:
    return [F.col("db"), F.col("key"), F.lit(kind).alias("type"), F.col("expiry_ms"), F.col("lru_idle_secs"), F.col("lfu_frequency"), F.col(encoding).alias("encoding"), count.cast(U64).alias("num_elements")]


def _whole(n: Column) -> Column:
    """Elements of the whole key, chunks together."""
    return F.coalesce(F.col("total_elements"), n)


def table(entries: DataFrame, kind: str, heuristics: frozenset[str] = frozenset(HEURISTICS), order: bool = False) -> DataFrame:
    """The table of one type. With order, file and seq lead, by which (and index) the snapshot's order can be restored.

    Every entry has a row at least: an empty collection has one with null elements and num_elements 0, an empty module
    value one of opcode eof. A sorted set whose scores all are positions is in geo beside zset, if the heuristic is on;
    a sketch in a string is in hyperloglog instead of string.
    """
    lead = [F.col("file"), F.col("seq")] if order else []
    if kind == "string":
        rows = entries.where((F.col("type") == "string") & ~C.is_hll(F.col("str")))
        return rows.select(*lead, *_common(kind, F.lit(1)), F.col("str").alias("value"))
    if kind == "hyperloglog":
        rows = entries.where((F.col("type") == "string") & C.is_hll(F.col("str")))
        return rows.select(*lead, *_common(kind, F.lit(1)), C.hll_encoding(F.col("str")).alias("hll_encoding"), C.hll_cached_cardinality(F.col("str")).alias("cached_cardinality"), F.col("str").alias("raw_value"))
    if kind == "list":
        rows = entries.where(F.col("type") == "list").select(*lead, *_common(kind, _whole(F.size("elems"))), F.col("element_offset"), F.posexplode_outer("elems").alias("pos", "element"))
        index = F.when(F.col("pos").isNotNull(), F.coalesce("element_offset", F.lit(0)) + F.col("pos")).cast(U64)
        return rows.withColumn("index", index).select(*[c for c in rows.columns if c not in ("element_offset", "pos", "element")], "index", "element")
    if kind == "set":
        return entries.where(F.col("type") == "set").select(*lead, *_common(kind, _whole(F.size("elems"))), F.explode_outer("elems").alias("member"))
    if kind == "zset":
        return entries.where(F.col("type") == "zset").select(*lead, *_common(kind, _whole(F.size("scored"))), F.inline_outer("scored").alias("member", "score"))
    if kind == "geo":
        rows = entries.where((F.col("type") == "zset") & C.is_geo()) if "geo" in heuristics else entries.where(F.lit(False))
        rows = rows.select(*lead, *_common(kind, F.size("scored")), F.inline_outer("scored").alias("member", "score"))
        return rows.select(*rows.columns[:-1], C.geohash_longitude(F.col("score")).alias("longitude"), C.geohash_latitude(F.col("score")).alias("latitude"), F.col("score").alias("geohash_score"))
    if kind == "hash":
        rows = entries.where(F.col("type") == "hash").select(*lead, *_common(kind, _whole(F.size("fields"))), F.inline_outer("fields").alias("field", "field_value", "field_expiry_ms"))
        return rows
    if kind == "module":
        rows = entries.where(F.col("type") == "module").select(*lead, *_common(kind, F.size("module.values")), F.col("module.name").alias("module_name"), F.col("module.version").alias("module_version"), F.posexplode_outer("module.values").alias("pos", "v"))
        return rows.select(*[c for c in rows.columns if c not in ("pos", "v")], F.coalesce(F.col("pos").cast("bigint"), F.lit(0)).alias("value_index"), F.coalesce("v.opcode", F.lit("eof")).alias("opcode"), "v.int_value", "v.double_value", "v.string_value")
    if kind == "stream":
        rows = entries.where(F.col("type") == "stream").select(*lead, *_common(kind, F.size("stream.entries")), F.explode_outer("stream.entries").alias("e"))
        kept = [c for c in rows.columns if c != "e"]
        return rows.select(*kept, F.col("e.id").alias("stream_id"), F.explode_outer("e.fields").alias("f")).select(*kept, "stream_id", F.col("f.field").alias("field"), F.col("f.value").alias("field_value"))
    raise ValueError(f"unknown type {kind!r}; known: {', '.join(TYPES)}")


def select_entries(entries: DataFrame, db: int | None = None, types: str | set[str] | None = None, key_pattern: str | None = None, max_entry_bytes: int | None = None, heuristics: frozenset[str] = frozenset(HEURISTICS)) -> DataFrame:
    """Entries of a db, of some types, of keys that match a glob, and of at most so many bytes.

    An entry is of its primary type; a sorted set of positions also is of type geo while that heuristic is on. Sizes are
    looked at chunk by chunk. All conditions are plain columns.
    """
    out = entries
    if db is not None:
        out = out.where(F.col("db") == db)
    chosen = parse_types(types) if isinstance(types, str) else types
    if chosen is not None:
        condition = C.primary_type().isin(*sorted(chosen))
        if "geo" in chosen and "geo" in heuristics:
            condition = condition | ((F.col("type") == "zset") & C.is_geo())
        out = out.where(condition)
    if key_pattern is not None:
        out = out.where(C.key_matches(key_pattern))
    if max_entry_bytes is not None:
        out = out.where(C.estimated_bytes() <= max_entry_bytes)
    return out


def tables(entries: DataFrame, types: str | set[str] | None = None, heuristics: frozenset[str] = frozenset(HEURISTICS), order: bool = False) -> dict[str, DataFrame]:
    """The tables asked for (default: all nine), and no others: geo alone doesn't give zset, nor zset geo."""
    chosen = parse_types(types) if isinstance(types, str) else types
    return {k: table(entries, k, heuristics, order) for k in TYPES if chosen is None or k in chosen}

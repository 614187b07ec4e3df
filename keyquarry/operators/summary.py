"""Counts of keys and rows, and the comparison of an export with its snapshot."""

from __future__ import annotations

import re

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.schemas import HEURISTICS, TYPES, parse_heuristics
from ..sources.parquetblocks import open_fs
from .tables import PART_BYTES, read_entries, read_info


def _slim(entries: DataFrame, heuristics: frozenset[str]) -> DataFrame:
    """(db, type, n, is_key, rows), with another row for entries that are geo besides."""
    geo = (F.col("type") == "zset") & C.is_geo() if "geo" in heuristics else F.lit(False)
    kinds = F.when(geo, F.array(F.lit("zset"), F.lit("geo"))).otherwise(F.array(C.primary_type()))
    slim = entries.select("db", C.is_first_chunk().cast("bigint").alias("is_key"), C.row_count().alias("rows"), F.posexplode(kinds).alias("n", "type"))
    return slim


def counts(entries: DataFrame, heuristics: frozenset[str] = frozenset(HEURISTICS)) -> DataFrame:
    """(level, db, type, keys, rows) for level type, db, db_type and all, of what was seen.

    A key in several chunks is one key. Per type a key that is geo besides counts in both; per db and in all once.
    """
    slim = _slim(entries, heuristics)
    own = F.when(F.col("n") == 0, F.col("is_key")).otherwise(0)
    grouped = slim.groupingSets([[F.col("type")], [F.col("db")], [F.col("db"), F.col("type")], []], "db", "type").agg(F.sum("is_key").alias("all_keys"), F.sum(own).alias("own_keys"), F.sum("rows").alias("rows"), F.sum(F.when(F.col("n") == 0, F.col("rows")).otherwise(0)).alias("own_rows"), F.grouping_id().alias("g"))
    typed = F.col("g").isin(0, 2)
    level = F.when(F.col("g") == 0, "db_type").when(F.col("g") == 1, "db").when(F.col("g") == 2, "type").otherwise("all")
    return grouped.select(level.alias("level"), "db", "type", F.coalesce(F.when(typed, F.col("all_keys")).otherwise(F.col("own_keys")), F.lit(0)).alias("keys"), F.coalesce(F.when(typed, F.col("rows")).otherwise(F.col("own_rows")), F.lit(0)).alias("rows"))


def type_counts(entries: DataFrame, heuristics: frozenset[str] = frozenset(HEURISTICS)) -> DataFrame:
    return _slim(entries, heuristics).groupBy("type").agg(F.sum("is_key").alias("keys"), F.sum("rows").alias("rows"))


def skip_counts(entries: DataFrame, max_entry_bytes: int | None) -> DataFrame:
    """(oversized, kept): entries that a size limit leaves out, and the others."""
    over = F.lit(False) if max_entry_bytes is None else C.estimated_bytes() > max_entry_bytes
    return entries.agg(F.count_if(over).alias("oversized"), F.count_if(~over).alias("kept"))


def inspect(spark: SparkSession, path: str, heuristics: str = "all", **options) -> dict:
    """Magic, versions, number of keys, and keys per db and type (in the types' order) of one snapshot or several alike."""
    entries = read_entries(spark, path, **{"shallow": True, "partBytes": PART_BYTES} | options)  # keys are counted, no rows
    rows = counts(entries, parse_heuristics(heuristics)).where(F.col("level") != "type").collect()
    head = read_info(spark, path, drain=False).orderBy("file").first()
    dbs: dict[int, dict] = {}
    total = 0
    for r in rows:
        if r["level"] == "all":
            total = r["keys"]
        elif r["level"] == "db":
            dbs.setdefault(r["db"], {"db": r["db"], "types": {}})["keys"] = r["keys"]
        else:
            dbs.setdefault(r["db"], {"db": r["db"], "types": {}})["types"][r["type"]] = r["keys"]
    for d in dbs.values():
        d["types"] = {t: d["types"][t] for t in TYPES if t in d["types"]}
    return {"magic": head["magic"], "rdb_version": head["version"], "server_version": head["server_version"], "total_keys": total, "dbs": [dbs[k] for k in sorted(dbs)]}


def reconcile(source: DataFrame, exported: DataFrame) -> DataFrame:
    """(type, keys, rdb_rows, parquet_rows, status) from (type, keys, rows) and (type, rows), by full outer join.

    status: ok, MISMATCH, MISSING (only in the snapshot) or EXTRA (only in the export).
    """
    left = source.select("type", "keys", F.col("rows").alias("rdb_rows"))
    right = exported.select("type", F.col("rows").alias("parquet_rows"))
    status = F.when(F.col("parquet_rows").isNull(), "MISSING").when(F.col("rdb_rows").isNull(), "EXTRA").when(F.col("rdb_rows") == F.col("parquet_rows"), "ok").otherwise("MISMATCH")
    return left.join(right, "type", "full_outer").withColumn("status", status)


def export_files(folder: str, kind: str) -> list[str]:
    """Files of a type in an export: {type}.parquet and {type}.{shard}.parquet, each a file or a folder of files."""
    filesystem, name = open_fs(folder)
    out = []
    for f in filesystem.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
        if re.fullmatch(rf"{kind}(\.[A-Za-z0-9_-]+)?\.parquet", f.base_name):
            if f.type == pafs.FileType.Directory:
                out += [x.path for x in filesystem.get_file_info(pafs.FileSelector(f.path)) if x.base_name.endswith(".parquet") and x.base_name[0] not in "_."]
            else:
                out.append(f.path)
    return sorted(out)


def exported_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(type, rows) of an export; Spark counts from the footers, in parallel."""
    parts = []
    filesystem, _ = open_fs(folder)
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
    for kind in TYPES:
        files = export_files(folder, kind)
        if files:
            parts.append(spark.read.parquet(*[scheme + f for f in files]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("type"), "rows"))
    if not parts:
        return spark.createDataFrame([], "type string, rows bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exported_heuristics(folder: str) -> frozenset[str]:
    """The heuristics an export was made with, from the first file that tells; all where none does."""
    filesystem, _ = open_fs(folder)
    for kind in TYPES:
        for f in export_files(folder, kind):
            with filesystem.open_input_file(f) as source:
                metadata = pq.read_schema(source).metadata or {}
            if b"rdb.heuristics" in metadata:
                return parse_heuristics(metadata[b"rdb.heuristics"].decode())
            return frozenset(HEURISTICS)
    return frozenset(HEURISTICS)


def validate(spark: SparkSession, path: str, folder: str, **options) -> DataFrame:
    """Compare a snapshot with its Parquet export, with the heuristics that the export names."""
    entries = read_entries(spark, path, **{"partBytes": PART_BYTES} | options)
    return reconcile(type_counts(entries, exported_heuristics(folder)), exported_counts(spark, folder))


def thousands(n: int | None) -> str:
    return "-" if n is None else f"{n:,}"

"""Queries over snapshots: the test tables are written as snapshot files and read back through the source."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.schemas import HEURISTICS, schema_for
from ..operators import summary
from ..operators.tables import read_entries, read_info, select_entries, table
from ..runtime import fresh_path, utf8
from ..sources import sinks
from ..sources.parquetblocks import open_fs

Query = Callable[[SparkSession, str], DataFrame]
ALL = frozenset(HEURISTICS)


def path_of(spark: SparkSession, sf_dir: str, *names: str) -> str:
    from testkit.keyspace import build  # writes snapshots, which the product doesn't

    return ",".join(build(spark, sf_dir, n) for n in names)


def entries(spark: SparkSession, sf_dir: str, *names: str, **options) -> DataFrame:
    return read_entries(spark, path_of(spark, sf_dir, *names), **options)


def text(name: str, alias: str | None = None) -> Column:
    return utf8(F.col(name)).alias(alias or name)


def long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def k_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "strings"), "string").select("db", text("key"), "type", text("value"))


def hashes(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(entries(spark, sf_dir, name), "hash").select(text("key"), text("field"), text("field_value"), "expiry_ms", long("num_elements"))

    return query


def lists(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(entries(spark, sf_dir, name), "list").select(text("key"), long("index"), text("element"), long("num_elements"))

    return query


def sets(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(entries(spark, sf_dir, name), "set").select(text("key"), text("member"))

    return query


def zsets(name: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(entries(spark, sf_dir, name, **options), "zset").select(text("key"), text("member"), "score", long("num_elements"))

    return query


def streams(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(entries(spark, sf_dir, name), "stream").select(text("key"), "stream_id", text("field"), text("field_value"), long("num_elements"))

    return query


def k_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(entries(spark, sf_dir, "geo", chunking=False), "geo")
    return rows.select(text("key"), text("member"), F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), "geohash_score")


def k_geo_as_zset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "geo", chunking=False), "zset").select(text("key"), text("member"), "score")


def k_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "hll"), "hyperloglog").select(text("key"), "type", "hll_encoding", "cached_cardinality")


def k_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "module"), "module").select(text("key"), "value_index", "opcode", long("int_value"), "double_value", text("string_value"))


def k_hash2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "hash2"), "hash").select(text("key"), text("field"), text("field_value"), "field_expiry_ms")


def k_lzf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "lzf"), "string").select(text("key"), F.char_length(F.col("value").cast("string")).cast("bigint").alias("n_chars"), F.md5("value").alias("value_md5"))


MIXED = ("strings", "list", "hash")


def summary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.type_counts(entries(spark, sf_dir, *MIXED))


def summary_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key in several chunks is one key."""
    return summary.type_counts(entries(spark, sf_dir, "list_plain", "zset", maxKeyElements=2))


def summary_db_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.counts(entries(spark, sf_dir, "strings"))
    return found.where(F.col("level") == "db").select("db", "keys")


def summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels at once; geo counts beside zset per type, and once per db and in all."""
    found = summary.counts(entries(spark, sf_dir, "strings", "geo", chunking=False))
    return found.select("level", F.coalesce("db", F.lit(-1)).alias("db"), F.coalesce("type", F.lit("")).alias("type"), "keys", "rows")


def snapshot_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = read_info(spark, path_of(spark, sf_dir, "strings", "list_ziplist"))
    return info.groupBy("magic", F.col("version").cast("bigint").alias("version"), "server_version", long("ctime"), "crc_checked").agg(F.count(F.lit(1)).alias("files"))


def filter_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "strings", db=2), "string").select(text("key"), text("value"))


def filter_db_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(select_entries(entries(spark, sf_dir, "strings"), db=2), "string").select(text("key"), text("value"))


def filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.type_counts(select_entries(entries(spark, sf_dir, *MIXED, "geo", types="hash,zset", chunking=False), types="hash,geo"))


def filter_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(entries(spark, sf_dir, "hash", keyPattern="customer:1*"), "hash")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).select(text("key"), "rows")


def filter_glob_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(select_entries(entries(spark, sf_dir, "hash"), key_pattern="customer:{1,2}?[0-4]"), "hash")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).select(text("key"), "rows")


def filter_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(select_entries(entries(spark, sf_dir, "lzf"), max_entry_bytes=2000), "string").select(text("key"))


def skipped_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.skip_counts(entries(spark, sf_dir, "lzf"), 2000)


def expiry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that expire, with the time as a timestamp."""
    keys = entries(spark, sf_dir, "hash").where(F.col("expiry_ms").isNotNull() & (F.year(F.timestamp_millis("expiry_ms")) == 2100))
    return keys.agg(F.count(F.lit(1)).alias("with_ttl"))


def validation(change: str) -> Query:
    """Export the strings, change the export, and reconcile it with its snapshot."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, out = path_of(spark, sf_dir, "strings"), fresh_path(spark, "export")
        found = read_entries(spark, source)
        rows = table(found, "string")
        if change == "mismatch":
            rows = rows.where(F.col("db") != 2)
        if change != "missing":
            sinks.write_table(rows, f"{out}/string.parquet", "string", metadata=sinks.export_metadata({}, ALL))
        if change == "extra":
            sinks.write_table(table(entries(spark, sf_dir, "hash"), "hash"), f"{out}/hash.parquet", "hash")
        return summary.validate(spark, source, out).select("type", "rdb_rows", "parquet_rows", "status")

    return query


def export_roundtrip(form: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fresh_path(spark, "export")
        found = entries(spark, sf_dir, "hash")
        sinks.export(found, out, form, **options)
        folder = f"{out}/hash.{sinks.EXTENSIONS[form]}"
        if form == "arrow-ipc":
            back = read_arrow(spark, folder, "hash")
        elif form == "csv":
            back = spark.read.csv(folder, header=True)
        else:
            back = spark.read.format(form).load(folder)
        value = (lambda c: utf8(F.unhex(c)).alias(c)) if form in ("csv", "json") else text
        return back.select(value("key"), value("field"), value("field_value"), F.col("expiry_ms").cast("bigint").alias("expiry_ms"), long("num_elements"))

    return query


def read_arrow(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Arrow IPC files of a type's export as a DataFrame, a file per task."""
    filesystem, name = open_fs(folder)
    files = sorted(f.path for f in filesystem.get_file_info(pafs.FileSelector(name)) if f.base_name.endswith(".arrow"))
    schema = schema_for(kind)
    types = to_arrow_schema(schema)

    def read(batches):
        fs, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f, pa.ipc.open_file(f) as r:
                    for i in range(r.num_record_batches):
                        yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(r.get_batch(i).columns, types)], types.names)

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    return listed.mapInArrow(read, schema)


def union_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of different snapshots beside each other in one folder, told apart by shard."""
    out = fresh_path(spark, "export")
    sinks.export(entries(spark, sf_dir, "hash"), out, shard="a")
    sinks.export(entries(spark, sf_dir, "hash2"), out, shard="b")
    return summary.exported_counts(spark, out)


QUERIES: dict[str, Query] = {f.__name__: f for f in (k_strings, k_geo, k_geo_as_zset, k_hll, k_module, k_hash2, k_lzf, summary_types, summary_chunked, summary_db_keys, summary_all, snapshot_info, filter_db, filter_db_column, filter_type, filter_glob, filter_glob_column, filter_oversize, skipped_oversize, expiry_view, union_shards)}
QUERIES |= {f"k_{n}": hashes(n) for n in ("hash", "hash_ziplist", "hash_plain")}
QUERIES |= {f"k_{n}": lists(n) for n in ("list", "list_quicklist1", "list_ziplist", "list_plain")}
QUERIES |= {f"k_{n}": sets(n) for n in ("set", "set_listpack", "set_plain")}
QUERIES |= {"k_zset": zsets("zset", maxKeyElements=1000), "k_zset_unchunked": zsets("zset", chunking=False)} | {f"k_{n}": zsets(n) for n in ("zset_listpack", "zset_ziplist", "zset_v1")}
QUERIES |= {f"k_{n}": streams(n) for n in ("stream", "stream_v1", "stream_v2")}
QUERIES |= {f"validate_{c}": validation(c) for c in ("status", "missing", "extra", "mismatch")}
QUERIES |= {"export_parquet_roundtrip": export_roundtrip("parquet"), "export_row_groups_roundtrip": export_roundtrip("parquet", row_group_size=500), "export_arrow_roundtrip": export_roundtrip("arrow-ipc"), "export_csv_roundtrip": export_roundtrip("csv"), "export_json_roundtrip": export_roundtrip("json")}

HASH = """
SELECT 'customer:' || c_custkey AS key, u.field AS field, u.v AS field_value, CASE WHEN c_custkey % 2 = 0 THEN 4102444800000 + c_custkey END AS expiry_ms, CAST(3 AS BIGINT) AS num_elements
FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS field, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS v FROM customer) u"""
LIST = """
SELECT 'orders:' || o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS index, CAST(o_orderkey AS VARCHAR) AS element, count(*) OVER (PARTITION BY o_custkey) AS num_elements FROM orders"""
SET = "SELECT 'brand:' || p_brand AS key, CAST(p_partkey AS VARCHAR) AS member FROM part"
ZSET = """
SELECT 'totals:' || o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS member, o_totalprice AS score, count(*) OVER (PARTITION BY o_orderpriority) AS num_elements FROM orders"""
STREAM = """
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS seq FROM events)
SELECT 'user:' || user_id AS key, ms || '-' || seq AS stream_id, u.f AS field, CASE u.f WHEN 'type' THEN event_type ELSE CAST(event_id AS VARCHAR) END AS field_value,
       count(*) OVER (PARTITION BY user_id, u.f) AS num_elements FROM e CROSS JOIN (SELECT unnest(['type', 'event']) AS f) u"""
GATHER = ", ".join(
    f"x{i} AS (SELECT c_custkey, c_nationkey, b, (la | (la >> {shift})) & {mask} AS la, (lo | (lo >> {shift})) & {mask} AS lo FROM x{i - 1})"
    for i, (shift, mask) in enumerate(((1, 3689348814741910323), (2, 1085102592571150095), (4, 71777214294589695), (8, 281470681808895), (16, 4294967295)), 1)
)
SPOT = "SELECT c_custkey, c_nationkey, CAST((CAST(c_custkey AS HUGEINT) * 299999999977) % 4503599627370496 AS BIGINT) AS b FROM customer"
GEO = f"""
WITH s AS ({SPOT}), x0 AS (SELECT *, b & 6148914691236517205 AS la, (b >> 1) & 6148914691236517205 AS lo FROM s), {GATHER}
SELECT 'geo:' || c_nationkey AS key, CAST(c_custkey AS VARCHAR) AS member,
       round(((-180e0 + (lo / 67108864e0) * 360e0) + (-180e0 + ((lo + 1e0) / 67108864e0) * 360e0)) / 2, 6) AS longitude,
       round(((-85.05112878e0 + (la / 67108864e0) * 170.10225756e0) + (-85.05112878e0 + ((la + 1e0) / 67108864e0) * 170.10225756e0)) / 2, 6) AS latitude,
       CAST(b AS DOUBLE) AS geohash_score FROM x5"""

SQL: dict[str, str] = {
    "k_strings": "SELECT CAST(n_regionkey AS BIGINT) AS db, 'nation:' || n_nationkey AS key, 'string' AS type, n_name AS value FROM nation",
    "k_geo": GEO,
    "k_geo_as_zset": f"SELECT 'geo:' || c_nationkey AS key, CAST(c_custkey AS VARCHAR) AS member, CAST(b AS DOUBLE) AS score FROM ({SPOT})",
    "k_hll": "SELECT 'hll:' || coalesce(lang, '') AS key, 'hyperloglog' AS type, 'sparse' AS hll_encoding, count(DISTINCT source) AS cached_cardinality FROM documents GROUP BY coalesce(lang, '')",
    "k_module": """
SELECT 'mod:' || p_partkey AS key, v.i AS value_index, CASE v.i WHEN 0 THEN 'uint' WHEN 1 THEN 'double' ELSE 'string' END AS opcode, CASE WHEN v.i = 0 THEN CAST(p_size AS BIGINT) END AS int_value,
       CASE WHEN v.i = 1 THEN p_retailprice END AS double_value, CASE WHEN v.i = 2 THEN p_name END AS string_value FROM part CROSS JOIN (SELECT unnest([0::BIGINT, 1, 2]) AS i) v""",
    "k_hash2": """
SELECT 'supplier:' || s_suppkey AS key, u.f AS field, CASE u.f WHEN 'name' THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS field_value, CASE WHEN u.f = 'nation' THEN 4102444800000 END AS field_expiry_ms
FROM supplier CROSS JOIN (SELECT unnest(['name', 'nation']) AS f) u""",
    "k_lzf": "SELECT 'doc:' || doc_id AS key, length(text) AS n_chars, md5(text) AS value_md5 FROM documents WHERE text IS NOT NULL",
    "summary_types": """
SELECT 'string' AS type, count(*) AS keys, count(*) AS rows FROM nation UNION ALL SELECT 'list', count(DISTINCT o_custkey), count(*) FROM orders UNION ALL SELECT 'hash', count(*), 3 * count(*) FROM customer""",
    "summary_chunked": """
SELECT 'list' AS type, count(DISTINCT o_custkey) AS keys, count(*) AS rows FROM orders UNION ALL SELECT 'zset', count(DISTINCT o_orderpriority), count(*) FROM orders""",
    "summary_db_keys": "SELECT CAST(n_regionkey AS BIGINT) AS db, count(*) AS keys FROM nation GROUP BY 1",
    "summary_all": """
WITH e AS (SELECT CAST(n_regionkey AS BIGINT) AS db, 'string' AS type, 1 AS k, 1 AS r, 1 AS own FROM nation
  UNION ALL SELECT 0, 'zset', 1, count(*), 1 FROM customer GROUP BY c_nationkey UNION ALL SELECT 0, 'geo', 1, count(*), 0 FROM customer GROUP BY c_nationkey)
SELECT 'type' AS level, CAST(-1 AS BIGINT) AS db, type, CAST(sum(k) AS BIGINT) AS keys, CAST(sum(r) AS BIGINT) AS rows FROM e GROUP BY type
UNION ALL SELECT 'db', db, '', CAST(sum(own) AS BIGINT), CAST(sum(r * own) AS BIGINT) FROM e GROUP BY db
UNION ALL SELECT 'db_type', db, type, CAST(sum(k) AS BIGINT), CAST(sum(r) AS BIGINT) FROM e GROUP BY db, type
UNION ALL SELECT 'all', -1, '', CAST(sum(own) AS BIGINT), CAST(sum(r * own) AS BIGINT) FROM e""",
    "filter_db": "SELECT 'nation:' || n_nationkey AS key, n_name AS value FROM nation WHERE n_regionkey = 2",
    "filter_type": """
SELECT 'hash' AS type, count(*) AS keys, 3 * count(*) AS rows FROM customer UNION ALL SELECT 'zset', count(DISTINCT c_nationkey), count(*) FROM customer UNION ALL SELECT 'geo', count(DISTINCT c_nationkey), count(*) FROM customer""",
    "filter_glob": "SELECT 'customer:' || c_custkey AS key, count(*) * 3 AS rows FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '1%' GROUP BY 1",
    "filter_glob_column": "SELECT 'customer:' || c_custkey AS key, CAST(3 AS BIGINT) AS rows FROM customer WHERE regexp_full_match(CAST(c_custkey AS VARCHAR), '[12].[0-4]')",
    "filter_oversize": "SELECT 'doc:' || doc_id AS key FROM documents WHERE text IS NOT NULL AND strlen('doc:' || doc_id) + strlen(text) <= 2000",
    "skipped_oversize": """
SELECT count(*) FILTER (strlen('doc:' || doc_id) + strlen(text) > 2000) AS oversized, count(*) FILTER (strlen('doc:' || doc_id) + strlen(text) <= 2000) AS kept FROM documents WHERE text IS NOT NULL""",
    "expiry_view": "SELECT count(*) AS with_ttl FROM customer WHERE c_custkey % 2 = 0",
    "snapshot_info": """
SELECT * FROM (VALUES ('VALKEY', CAST(80 AS BIGINT), '8.0.1', CAST(1704067200 AS BIGINT), true, CAST(4 AS BIGINT)), ('REDIS', 11, '8.0.1', 1704067200, true, 4)) t(magic, version, server_version, ctime, crc_checked, files)""",
    "validate_status": "SELECT 'string' AS type, count(*) AS rdb_rows, count(*) AS parquet_rows, 'ok' AS status FROM nation",
    "validate_missing": "SELECT 'string' AS type, count(*) AS rdb_rows, CAST(NULL AS BIGINT) AS parquet_rows, 'MISSING' AS status FROM nation",
    "validate_mismatch": "SELECT 'string' AS type, count(*) AS rdb_rows, count(*) FILTER (n_regionkey <> 2) AS parquet_rows, 'MISMATCH' AS status FROM nation",
    "validate_extra": """
SELECT 'string' AS type, count(*) AS rdb_rows, count(*) AS parquet_rows, 'ok' AS status FROM nation UNION ALL SELECT 'hash', NULL, 3 * count(*), 'EXTRA' FROM customer""",
    "union_shards": "SELECT 'hash' AS type, (SELECT 3 * count(*) FROM customer) + (SELECT 2 * count(*) FROM supplier) AS rows",
}
SQL["filter_db_column"] = SQL["filter_db"]
SQL |= {k: s for k in QUERIES for p, s in (("k_list", LIST), ("k_set", SET), ("k_zset", ZSET), ("k_stream", STREAM)) if k == p or k.startswith(p + "_")}
SQL |= {k: HASH for k in ("k_hash", "k_hash_ziplist", "k_hash_plain", *(k for k in QUERIES if k.startswith("export_")))}

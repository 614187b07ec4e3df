"""Queries of the format's and the interfaces' details: opcodes, empties, encodings, codecs, order, schemas, exit codes."""

from __future__ import annotations

import io
from contextlib import redirect_stderr, redirect_stdout

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, cli
from ..functions.schemas import PRINTED, TYPES
from ..operators.tables import read_entries, read_info, table
from ..runtime import fresh_path
from ..sources import sinks
from ..sources.parquetblocks import open_fs
from ..streaming.snapshots import follow
from .snapshots import HASH, Query, entries, long, path_of, text


def k_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "evictions"), "string").select(text("key"), "expiry_ms", long("lru_idle_secs"), long("lfu_frequency"), long("num_elements"))


def k_passed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, module data, slots and sizes between entries change none of them."""
    return table(entries(spark, sf_dir, "passed_over"), "string").select(text("key"), text("value"), "expiry_ms", "db")


def k_zipmaps_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a type that isn't read are counted, and the others read."""
    path = path_of(spark, sf_dir, "zipmaps")
    skipped = read_info(spark, path).select(F.lit(0).alias("keys"), F.col("skipped_unknown").alias("skipped"))
    kept = read_entries(spark, path).select(F.lit(1).alias("keys"), F.lit(0).cast("bigint").alias("skipped"))
    return skipped.unionByName(kept).agg(F.sum("keys").alias("keys"), F.sum("skipped").alias("skipped"))


def k_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every empty value has one row, of nulls."""
    found, own = entries(spark, sf_dir, "empties"), {"list": "element", "set": "member", "zset": "member", "hash": "field", "stream": "stream_id", "module": "int_value"}
    parts = [table(found, k).select(text("key"), "type", long("num_elements"), F.col(c).isNull().alias("is_null")) for k, c in own.items()]
    parts.append(table(found, "string").select(text("key"), "type", long("num_elements"), (F.octet_length("value") == 0).alias("is_null")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def k_hll_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "dense"), "hyperloglog").select(text("key"), "hll_encoding", "cached_cardinality", F.octet_length("raw_value").cast("bigint").alias("n_bytes"))


def k_module_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(entries(spark, sf_dir, "module_kinds"), "module").select(text("key"), "module_name", "module_version", "value_index", "opcode", long("int_value"), "double_value", long("num_elements"))


ENCODED = ("strings", "hash", "hash_ziplist", "hash_plain", "list", "list_quicklist1", "list_ziplist", "list_plain", "set", "set_listpack", "set_plain", "zset", "zset_listpack", "zset_ziplist", "zset_v1", "module", "stream", "stream_v1", "stream_v2", "hash2")


def k_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entries(spark, sf_dir, *ENCODED, shallow=True)
    return found.groupBy("type", long("type_code"), "encoding").agg(F.count(F.lit(1)).alias("keys"))


def k_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in their own order: positions as seq and index give them, and places of keys in a file without gaps."""
    found = entries(spark, sf_dir, "list")
    rows = table(found, "list", order=True)
    per_file = rows.groupBy("file").agg(F.count_distinct("seq").alias("keys"), F.max("seq").alias("top"))
    per_key = rows.groupBy("file", "seq").agg(F.array_sort(F.collect_list(F.struct("index", F.col("element").cast("string").cast("bigint").alias("v")))).alias("l"))
    rising = per_key.select("file", F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: (F.size("l") < 2) | (F.get("l", i)["v"] > F.get("l", i - 1)["v"])).alias("up"))
    both = rising.groupBy("file").agg(F.min("up").alias("up")).join(per_file, "file")
    return both.agg(F.sum("keys").alias("keys"), F.min(F.col("top") + 1 == F.col("keys")).alias("without_gaps"), F.min("up").alias("in_order"))


def k_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of large files, read in parts."""
    found = entries(spark, sf_dir, "hash_plain", partBytes=5_000)
    return table(found, "hash").select(text("key"), text("field"), text("field_value"), "expiry_ms", long("num_elements"))


def snapshot_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = read_info(spark, path_of(spark, sf_dir, "strings"))
    return info.select("server_version", long("ctime"), long("used_mem"), "repl_id", "repl_offset", F.map_keys("aux").alias("names")).select("*", F.array_join("names", ",").alias("aux_names")).drop("names").distinct()


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What api.inspect tells, as rows."""
    told = api.inspect(spark, path_of(spark, sf_dir, "strings", "geo", "dense"), chunking=False)
    rows = [(told["magic"], told["rdb_version"], told["server_version"], told["total_keys"], d["db"], d["keys"], t, n) for d in told["dbs"] for t, n in d["types"].items()]
    return spark.createDataFrame(rows, "magic string, version bigint, server_version string, total_keys bigint, db bigint, db_keys bigint, type string, keys bigint")


SEVERAL = ("strings", "hash", "list", "set", "zset", "geo", "hll", "module", "stream")


def api_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table that api.read gives."""
    rows = [(k, df.count()) for k, df in api.read(spark, path_of(spark, sf_dir, *SEVERAL), chunking=False).items()]
    return spark.createDataFrame(rows, "type string, rows bigint")


def api_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the Arrow batches that api.read_batches gives, by type."""
    rows: dict[str, int] = {}
    for kind, batch in api.read_batches(spark, path_of(spark, sf_dir, "strings", "hash", "geo", "module"), chunking=False):
        rows[kind] = rows.get(kind, 0) + batch.num_rows
    return spark.createDataFrame(list(rows.items()), "type string, rows bigint")


def _files(folder: str, extension: str) -> list[tuple[pafs.FileSystem, str]]:
    filesystem, name = open_fs(folder)
    return [(filesystem, f.path) for f in filesystem.get_file_info(pafs.FileSelector(name)) if f.base_name.endswith(extension)]


def export_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the files that exports write, with their Arrow types and whether they may be null."""
    out, rows = fresh_path(spark, "export"), set()
    found = entries(spark, sf_dir, *SEVERAL, chunking=False)
    for form, extension, schema in (("parquet", ".parquet", pq.read_schema), ("arrow-ipc", ".arrow", lambda f: pa.ipc.open_file(f).schema)):
        for kind in sinks.export(found, out, form):
            for filesystem, path in _files(f"{out}/{kind}{extension}", extension):
                with filesystem.open_input_file(path) as f:
                    rows |= {(form, kind, i, c.name, PRINTED[c.type], c.nullable) for i, c in enumerate(schema(f))}
    return spark.createDataFrame(sorted(rows), "form string, type string, place bigint, name string, arrow_type string, nullable boolean")


def export_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec in files' footers for each that may be asked for, and their rows."""
    rows = []
    for codec in sinks.CODECS:
        out = fresh_path(spark, "export")
        sinks.export(entries(spark, sf_dir, "strings"), out, compression=codec)
        metas = [pq.read_metadata(path, filesystem=filesystem) for filesystem, path in _files(f"{out}/string.parquet", ".parquet")]
        found = {m.row_group(i).column(1).compression for m in metas for i in range(m.num_row_groups)}
        rows.append((codec, ",".join(sorted(found)), sum(m.num_rows for m in metas)))
    return spark.createDataFrame(rows, "asked string, written string, rows bigint")


def export_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot metadata in the footers of an export."""
    out, path = fresh_path(spark, "export"), path_of(spark, sf_dir, "strings")
    api.export(spark, path, out, heuristic="none")
    rows = {(k.decode(), v.decode()) for filesystem, p in _files(f"{out}/string.parquet", ".parquet") for k, v in (pq.read_schema(p, filesystem=filesystem).metadata or {}).items() if k.startswith(b"rdb.") and k != b"rdb.exported_by"}
    return spark.createDataFrame(sorted(rows), "name string, value string")


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of a folder's snapshots, worked off as a stream."""
    source, out = path_of(spark, sf_dir, "hash"), fresh_path(spark, "followed")
    follow(spark, source, f"{out}/tables", f"{out}/checkpoint", {"hash"}, once=True, files_per_batch=2).awaitTermination()
    return spark.read.parquet(f"{out}/tables/hash.parquet").select(text("key"), text("field"), text("field_value"), "expiry_ms", long("num_elements"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line returns."""
    good, other, out = path_of(spark, sf_dir, "strings"), path_of(spark, sf_dir, "hash"), fresh_path(spark, "cli")
    filesystem, name = open_fs(fresh_path(spark, "torn"))
    with _files(good, ".rdb")[0][0].open_input_file(_files(good, ".rdb")[0][1]) as f:
        whole = f.read()
    with filesystem.open_output_stream(name) as f:
        f.write(whole[:-20])
    cases = {
        "export": ["export", good, "-o", out], "validate": ["validate", good, out], "schema": ["schema", "--type", "geo"], "no file": ["export", f"{out}/none.rdb", "-o", out], "damaged": ["export", name, "-o", f"{out}-2"],
        "other export": ["validate", other, out], "bad type": ["export", good, "--type", "x"], "bad shard": ["export", good, "--shard-id", "a/b"], "both chunk options": ["export", good, "--no-chunking", "--max-key-elements", "4"], "no command": [],
    }
    with redirect_stderr(io.StringIO()), redirect_stdout(io.StringIO()):
        rows = [(k, cli.main(v)) for k, v in cases.items()]
    return spark.createDataFrame(rows, "case string, code bigint")


QUERIES: dict[str, Query] = {f.__name__: f for f in (k_evictions, k_passed_over, k_zipmaps_skipped, k_empties, k_hll_dense, k_module_kinds, k_encodings, k_in_order, k_parts, snapshot_aux, inspected, api_read, api_batches, export_schemas, export_codecs, export_metadata, followed, exit_codes)}

LANGS = "SELECT coalesce(lang, '') AS l, count(DISTINCT source) AS n FROM documents GROUP BY 1"
COUNTS = """
SELECT 'string' AS type, count(*) AS rows FROM nation UNION ALL SELECT 'hash', 3 * count(*) FROM customer UNION ALL SELECT 'list', count(*) FROM orders UNION ALL SELECT 'set', count(*) FROM part
UNION ALL SELECT 'zset', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) UNION ALL SELECT 'geo', count(*) FROM customer UNION ALL SELECT 'hyperloglog', count(DISTINCT coalesce(lang, '')) FROM documents
UNION ALL SELECT 'module', 3 * count(*) FROM part UNION ALL SELECT 'stream', 2 * count(*) FROM events"""


def _schema_rows() -> str:
    """The columns as text: name, type, and ? where null is allowed."""
    common = "db UInt32, key Binary, type Utf8, expiry_ms Int64?, lru_idle_secs UInt64?, lfu_frequency UInt8?, encoding Utf8, num_elements UInt64"
    own = {
        "string": "value Binary", "list": "index UInt64?, element Binary?", "set": "member Binary?", "zset": "member Binary?, score Float64?", "hash": "field Binary?, field_value Binary?, field_expiry_ms Int64?",
        "geo": "member Binary?, longitude Float64?, latitude Float64?, geohash_score Float64?", "hyperloglog": "hll_encoding Utf8, cached_cardinality Int64, raw_value Binary",
        "module": "module_name Utf8, module_version UInt32, value_index UInt32, opcode Utf8, int_value UInt64?, double_value Float64?, string_value Binary?", "stream": "stream_id Utf8?, field Binary?, field_value Binary?",
    }
    rows = []
    for kind in TYPES:
        for i, column in enumerate(f"{common}, {own[kind]}".split(", ")):
            name, of = column.split(" ")
            rows.append(f"('{kind}', {i}, '{name}', '{of.rstrip('?')}', {str(of.endswith('?')).lower()})")
    return ", ".join(rows)


SQL: dict[str, str] = {
    "k_evictions": """
SELECT 'nation:' || n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN (2000000000 + n_nationkey) * 1000 END AS expiry_ms, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey * 1000 END AS lru_idle_secs,
       CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END AS lfu_frequency, CAST(1 AS BIGINT) AS num_elements FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)""",
    "k_passed_over": "SELECT 'nation:' || n_nationkey AS key, n_name AS value, CAST(NULL AS BIGINT) AS expiry_ms, CAST(0 AS BIGINT) AS db FROM nation",
    "k_zipmaps_skipped": "SELECT count(*) FILTER (n_nationkey % 5 <> 0) AS keys, CAST(count(*) FILTER (n_nationkey % 5 = 0) AS BIGINT) AS skipped FROM nation",
    "k_empties": """
SELECT 'nation:' || n_nationkey AS key, ['list', 'set', 'zset', 'hash', 'stream', 'module', 'string'][CAST(n_nationkey % 7 AS INT) + 1] AS type, CAST(CASE WHEN n_nationkey % 7 = 6 THEN 1 ELSE 0 END AS BIGINT) AS num_elements, true AS is_null FROM nation""",
    "k_hll_dense": f"SELECT 'hll:' || l AS key, 'dense' AS hll_encoding, CASE WHEN n % 2 = 1 THEN -1 ELSE n END AS cached_cardinality, CAST(12304 AS BIGINT) AS n_bytes FROM ({LANGS})",
    "k_module_kinds": """
SELECT 'mod:' || p_partkey AS key, 'testkinds' AS module_name, CAST(1000 AS BIGINT) AS module_version, v.i AS value_index, CASE v.i WHEN 0 THEN 'sint' ELSE 'float' END AS opcode, CASE WHEN v.i = 0 THEN CAST(p_size AS BIGINT) END AS int_value,
       CASE WHEN v.i = 1 THEN p_size / 4.0e0 END AS double_value, CAST(2 AS BIGINT) AS num_elements FROM part CROSS JOIN (SELECT unnest([0::BIGINT, 1]) AS i) v""",
    "k_encodings": """
WITH c(t, n) AS (SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'brand', count(DISTINCT p_brand) FROM part
  UNION ALL SELECT 'totals', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'user', count(DISTINCT user_id) FROM events UNION ALL SELECT 'supplier', count(*) FROM supplier),
e(t, type, type_code, encoding) AS (VALUES ('nation', 'string', 0, 'string'), ('customer', 'hash', 16, 'listpack'), ('customer', 'hash', 13, 'ziplist'), ('customer', 'hash', 4, 'hashtable'), ('orders', 'list', 18, 'quicklist2'), ('orders', 'list', 14, 'quicklist'),
  ('orders', 'list', 10, 'ziplist'), ('orders', 'list', 1, 'linkedlist'), ('brand', 'set', 11, 'intset'), ('brand', 'set', 20, 'listpack'), ('brand', 'set', 2, 'hashtable'), ('totals', 'zset', 5, 'skiplist'), ('totals', 'zset', 17, 'listpack'),
  ('totals', 'zset', 12, 'ziplist'), ('totals', 'zset', 3, 'skiplist'), ('part', 'module', 7, 'module'), ('user', 'stream', 21, 'stream3'), ('user', 'stream', 15, 'stream'), ('user', 'stream', 19, 'stream2'), ('supplier', 'hash', 22, 'hashtable'))
SELECT type, CAST(type_code AS BIGINT) AS type_code, encoding, CAST(n AS BIGINT) AS keys FROM e JOIN c USING (t)""",
    "k_in_order": "SELECT count(DISTINCT o_custkey) AS keys, true AS without_gaps, true AS in_order FROM orders",
    "snapshot_aux": "SELECT '8.0.1' AS server_version, CAST(1704067200 AS BIGINT) AS ctime, CAST(1048576 AS BIGINT) AS used_mem, repeat('0', 40) AS repl_id, CAST(0 AS BIGINT) AS repl_offset, 'ctime,repl-id,repl-offset,used-mem,valkey-ver' AS aux_names",
    "inspected": f"""
WITH k(db, type, n, own) AS (SELECT CAST(n_regionkey AS BIGINT), 'string', count(*), 1 FROM nation GROUP BY 1 UNION ALL SELECT 0, 'zset', count(DISTINCT c_nationkey), 1 FROM customer UNION ALL SELECT 0, 'geo', count(DISTINCT c_nationkey), 0 FROM customer
  UNION ALL SELECT 0, 'hyperloglog', count(*), 1 FROM ({LANGS}))
SELECT 'VALKEY' AS magic, CAST(80 AS BIGINT) AS version, '8.0.1' AS server_version, (SELECT CAST(sum(n * own) AS BIGINT) FROM k) AS total_keys, db, CAST(sum(n * own) OVER (PARTITION BY db) AS BIGINT) AS db_keys, type, CAST(n AS BIGINT) AS keys FROM k""",
    "api_read": COUNTS,
    "api_batches": """
SELECT 'string' AS type, count(*) AS rows FROM nation UNION ALL SELECT 'hash', 3 * count(*) FROM customer UNION ALL SELECT 'zset', count(*) FROM customer UNION ALL SELECT 'geo', count(*) FROM customer
UNION ALL SELECT 'module', 3 * count(*) FROM part""",
    "export_schemas": f"SELECT form, type, CAST(place AS BIGINT) AS place, name, arrow_type, nullable FROM (VALUES {_schema_rows()}) s(type, place, name, arrow_type, nullable) CROSS JOIN (VALUES ('parquet'), ('arrow-ipc')) f(form)",
    "export_codecs": """
SELECT asked, written, (SELECT count(*) FROM nation) AS rows FROM (VALUES ('zstd', 'ZSTD'), ('snappy', 'SNAPPY'), ('lz4', 'LZ4'), ('lz4-raw', 'LZ4'), ('lz4_raw', 'LZ4'), ('gzip', 'GZIP'), ('none', 'UNCOMPRESSED')) c(asked, written)""",
    "export_metadata": """
SELECT * FROM (VALUES ('rdb.valkey-ver', '8.0.1'), ('rdb.ctime', '1704067200'), ('rdb.used-mem', '1048576'), ('rdb.repl-id', repeat('0', 40)), ('rdb.repl-offset', '0'), ('rdb.heuristics', 'none')) m(name, value)""",
    "exit_codes": """
SELECT "case", CAST(code AS BIGINT) AS code FROM (VALUES ('export', 0), ('validate', 0), ('schema', 0), ('no file', 3), ('damaged', 4), ('other export', 5), ('bad type', 2), ('bad shard', 2), ('both chunk options', 2), ('no command', 2)) c("case", code)""",
}
SQL |= dict.fromkeys(("k_parts", "followed"), HASH)

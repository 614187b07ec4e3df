"""Queries of the general problems: 1, 2, 5, 6 and 7 (the others live in the llm subpackage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, history, skewstats, snapdiff, snapshots, widetable
from ..runtime import small_table, utf8
from ..sources.parquetblocks import SMALL_BYTES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(name: str) -> Column:
    return utf8(F.col(name)).alias(name)


def long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def wide_hashes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The wide table over every node's last snapshot that counts, and its attributes."""
    spec = widetable.read_spec(table(spark, sf_dir, "attr_spec"))
    last = small_table(snapshots.latest_snapshots(table(spark, sf_dir, "snapshot_file")).select("snap_id"))
    pairs = table(spark, sf_dir, "kv_hash").select("snap_id", "db", "key", "field", "value").join(last, "snap_id")
    return widetable.wide_table(pairs, spec), spec


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed columns, times as microseconds and booleans as 0 and 1."""
    wide, spec = wide_hashes(spark, sf_dir)
    plain = {"ts": F.unix_micros, "bool": lambda a: F.col(a).cast("int").cast("bigint")}
    return wide.select(long("snap_id"), long("db"), text("key"), *[plain.get(k, F.col)(a).alias(a) for a, k in spec])


def p1_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that fit no column's type."""
    wide, _ = wide_hashes(spark, sf_dir)
    return wide.select(long("snap_id"), long("db"), text("key"), F.explode("cast_failures").alias("attr", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, spec = wide_hashes(spark, sf_dir)
    return widetable.filled_cells(wide, spec).select(long("snap_id"), long("db"), text("key"), "attr")


def compacted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kv_stream, read from its joined files."""
    source = table(spark, sf_dir, "kv_stream")
    folder, _ = compaction.compact_files(spark, f"{sf_dir}/kv_stream.parquet")
    return spark.read.schema(source.schema).parquet(folder)


def joined_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """kv_stream from the files that its tiny files were joined to, and the report of that."""
    from testkit.tinyfiles import build  # writes the tiny files, which the test data have as file_id only

    source = table(spark, sf_dir, "kv_stream")
    folder, report = compaction.compact_files(spark, build(spark, sf_dir))
    return spark.read.schema(source.schema).parquet(folder), report


def id_part(name: str) -> Column:
    """A number of a stream id as BIGINT; the format's ids of 2^63 and more don't fit and are an error, never null."""
    c = F.col(name)
    return F.when(c > F.lit(2**63 - 1), F.raise_error(F.concat(F.lit(f"{name} past 63 bits: "), c.cast("string")))).otherwise(c.cast("bigint")).cast("bigint").alias(name)


def plain_stream(rows: DataFrame, *more: str) -> DataFrame:
    """All columns of kv_stream, comparable, and some more."""
    return rows.select(*more, long("snap_id"), long("db"), text("key"), "type", long("expiry_ms"), long("lru_idle_secs"), long("lfu_frequency"), "encoding", long("num_elements"), "stream_id", text("field"), F.hex("field_value").alias("value_hex"), long("file_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compaction.held_by_several(compacted_stream(spark, sf_dir))
    return found.select(long("snap_id"), long("db"), text("key"), id_part("id_ms"), id_part("id_seq"))


def p2_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and column of the tiny files, read from the joined ones."""
    return plain_stream(joined_stream(spark, sf_dir)[0])


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the joined files hold, and whether files are few and row groups of some size: all but one of each file."""
    report = joined_stream(spark, sf_dir)[1].agg(*[F.sum(c).alias(c) for c in ("n_files", "n_blocks", "n_groups", "n_rows", "n_bytes")], F.count(F.lit(1)).alias("n_out"))
    return report.select("n_files", "n_blocks", "n_rows", ((F.col("n_groups") - F.col("n_out")) * SMALL_BYTES <= F.col("n_bytes")).alias("few_groups"), (F.col("n_out") * 50 <= F.col("n_files")).alias("few_files"))


def p2_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry exactly once, with all columns, read from the files that hold the result."""
    from testkit.tinyfiles import build

    folder, _ = compaction.compact_entries(spark, build(spark, sf_dir))
    rows = spark.read.parquet(folder).withColumns({"id_ms": id_part("id_ms"), "id_seq": id_part("id_seq")})
    return plain_stream(rows, "id_ms", "id_seq")


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.version_runs(table(spark, sf_dir, "kv_hash"), table(spark, sf_dir, "snapshot_file"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = p5_versions(spark, sf_dir)
    return runs.select(F.col("from_snap_id").alias("snap_id"), long("db"), text("key"), text("field"), F.coalesce("until_snap_id", F.lit(0)).cast("bigint").alias("until_snap_id")).distinct()


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = p5_versions(spark, sf_dir)
    return runs.select(long("node_id"), long("db"), text("key"), text("field"), F.hex("value").alias("value_hex"), long("expiry_ms"), long("from_snap_id"), long("until_snap_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = skewstats.list_lengths(table(spark, sf_dir, "kv_list"))
    return lengths.where(~F.col("true_length").eqNullSafe(F.col("stated_length"))).select(long("snap_id"), long("db"), text("key"))


def p6_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = skewstats.list_lengths(table(spark, sf_dir, "kv_list"))
    return lengths.select(long("snap_id"), long("db"), text("key"), long("n_rows"), long("true_length"), long("stated_length"))


def p6_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["snap_id", "db", "key"]
    found = skewstats.modes(skewstats.weighted_values(table(spark, sf_dir, "kv_list"), key, "element", "value"), key)
    return found.select(long("snap_id"), long("db"), text("key"), "n_distinct", F.hex("mode").alias("mode_hex"), "mode_weight")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["snap_id", "db", "key"]
    sizes = skewstats.weighted_values(table(spark, sf_dir, "kv_list"), key, F.octet_length("element"))
    found = skewstats.percentiles(sizes, key, [0.0, 0.5, 0.9, 1.0])
    return found.select(long("snap_id"), long("db"), text("key"), "fraction", F.col("value").alias("n_bytes"))


def p7_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, _ = snapdiff.consecutive_changes(table(spark, sf_dir, "kv_string"), table(spark, sf_dir, "snapshot_file"))
    return changes.select(long("node_id"), long("snap_id"), long("previous_snap_id"), long("db"), text("key"), "change_kind")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_changes(spark, sf_dir).select("snap_id", "db", "key", "change_kind")


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p1_failures, p2_found, p2_compacted, p2_joined, p2_report, p5_found, p5_history, p6_found, p6_lists, p6_modes, p6_percentiles, p7_found, p7_changes)}

"""Few well-sized files out of very many small ones, without loss or repetition.

Two steps: files are joined by copying their encoded blocks (sources.parquetblocks), in parallel over bins of about the
target size; where the same entry was delivered in several files, the copies are then resolved to one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fresh_path, materialize, ship
from ..sources import parquetblocks

TARGET_BYTES = 256 << 20
FOOTERS_PER_TASK = 1000
#: Files that one task joins at most in a round, so that no task is long; what it writes is joined in the next round.
FILES_PER_BIN = 1000

#: A file: its own blocks and rows, and the input's files and blocks that it holds.
FACTS = "path string, length bigint, signature string, n_blocks bigint, n_rows bigint, held_files bigint, held_blocks bigint"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files under path; Spark lists them, in parallel where they are many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return materialize(files.where(F.col("path").endswith(".parquet")).select("path", "length"), "listing")


def read_facts(files: DataFrame) -> DataFrame:
    """FACTS of files from their footers, FOOTERS_PER_TASK of them in a task."""

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = parquetblocks.footers_facts(list(batch["path"]))
            yield batch.assign(**{name: [f[i] for f in found] for i, name in enumerate(("signature", "n_blocks", "n_rows"))}, held_files=1, held_blocks=[f[1] for f in found])

    tasks = max(1, files.count() // FOOTERS_PER_TASK)
    spread = files.repartition(tasks, F.xxhash64("path"))
    return materialize(spread.mapInPandas(facts, FACTS), "footers")


def plan_bins(facts: DataFrame, target_bytes: int, files_per_bin: int = FILES_PER_BIN) -> DataFrame:
    """facts with a column bin: which files go together.

    A task fills bins one after the other with files of one signature; it sees about 16 bins' worth of files, so few
    bins are left part full. The plan is written, so that a repeated task can't bin anew.
    """

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled: dict[str, tuple[str, int, int]] = {}
        for batch in batches:
            names = []
            for p, n, s in zip(batch["path"], batch["length"], batch["signature"]):
                name, size, files = filled.get(s, ("", 0, 0))
                if not name or size + n > target_bytes or files >= files_per_bin:
                    name, size, files = hashlib.sha1(p.encode()).hexdigest(), 0, 0
                filled[s] = (name, size + n, files + 1)
                names.append(name)
            yield batch.assign(bin=names)

    known = facts.agg(F.sum("length"), F.count(F.lit(1))).first()
    tasks = max(1, -(-(known[0] or 0) // (16 * target_bytes)), known[1] // (16 * files_per_bin))
    spread = facts.repartition(tasks, F.xxhash64("path")).sortWithinPartitions("path")
    return materialize(spread.mapInPandas(bins, f"{FACTS}, bin string"), "bins")


def _files_per_target(facts: DataFrame, target_bytes: int) -> float:
    """Of the signature with the smallest files: how many of them make a file of target_bytes."""
    each = facts.groupBy("signature").agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.ceil(F.sum("length") / target_bytes))).alias("n"))
    return each.agg(F.max("n")).first()[0] or 0


def _round(spark: SparkSession, facts: DataFrame, folder: str, target_bytes: int, files_per_bin: int, sizes: dict[str, int]) -> DataFrame:
    """Join facts' files into folder; FACTS of what was written, whose sums are compared with the plan's."""
    plan = plan_bins(facts, target_bytes, files_per_bin)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        target = f"{folder}/part-{hashlib.sha1(chr(10).join(pdf['path']).encode()).hexdigest()}.parquet"
        blocks, groups, rows, size = parquetblocks.join_files(list(pdf["path"]), target, **sizes)
        if (blocks, rows) != (pdf["n_blocks"].sum(), pdf["n_rows"].sum()):
            raise parquetblocks.IncompatibleBlocks(f"{target}: {blocks} blocks and {rows} rows read, {pdf['n_blocks'].sum()} and {pdf['n_rows'].sum()} planned")
        return pd.DataFrame({"path": [target], "length": [size], "signature": [pdf["signature"].iloc[0]], "n_blocks": [groups], "n_rows": [rows], "held_files": [pdf["held_files"].sum()], "held_blocks": [pdf["held_blocks"].sum()]})

    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop_path)
    bins = plan.select("bin").distinct().count()  # few, each a file to write: a task for each
    written = materialize(plan.repartition(max(1, bins), "bin").groupBy("bin").applyInPandas(join, FACTS), "compaction")
    sums = [F.sum(c) for c in ("held_files", "held_blocks", "n_rows")]
    planned, found = (tuple(x or 0 for x in df.agg(*sums).first()) for df in (plan, written))
    if planned != found:
        raise ValueError(f"files, blocks and rows planned {planned}, written {found}")
    return written


def compact_files(spark: SparkSession, path: str, out_dir: str | None = None, target_bytes: int = TARGET_BYTES, files_per_bin: int = FILES_PER_BIN, **sizes: int) -> tuple[str, DataFrame]:
    """Join the Parquet files under path into files of about target_bytes in out_dir (default: the shared folder).

    Returns the folder and a report, one row per file written: out_path, n_files, n_blocks, n_groups, n_rows, n_bytes;
    n_files and n_blocks are those of the input that it holds, n_groups its own row groups. Row groups of some size are
    copied as they are, smaller ones merged (sizes: small_bytes, group_bytes, group_rows; parquetblocks.join_files).
    Where a file of the target's size holds more than files_per_bin files, they are joined in rounds, so that no task is
    long. Files of different schemas never share a file. An input without rows is joined like any other; one that isn't
    a plain Parquet file, or whose block rows don't add up, is an error. In each round the sums of files, blocks and
    rows must be those of the footers that were read, else ValueError. No files at all give an empty folder and report.
    """
    if files_per_bin < 2:
        raise ValueError("files_per_bin must be 2 or more")
    ship(spark)
    folder = out_dir or fresh_path(spark, "compacted")
    facts = read_facts(list_files(spark, path))
    while _files_per_target(facts, target_bytes) > files_per_bin:
        facts = _round(spark, facts, fresh_path(spark, "round"), target_bytes, files_per_bin, sizes)
    written = _round(spark, facts, folder, target_bytes, files_per_bin, sizes)
    return folder, written.select(F.col("path").alias("out_path"), F.col("held_files").alias("n_files"), F.col("held_blocks").alias("n_blocks"), F.col("n_blocks").alias("n_groups"), "n_rows", F.col("length").alias("n_bytes"))


def stream_id_part(stream_id: Column, part: int) -> Column:
    """The first (0) or second (1) number of a stream id, DECIMAL(20,0); a missing second is 0, no number is null."""
    pieces = F.split(F.trim(stream_id), "-", 2)
    number = F.get(pieces, F.lit(part))
    number = F.when(number.rlike(r"^[0-9]+$"), number.try_cast("decimal(20,0)"))
    return F.when(F.size(pieces) == 1, F.when(stream_id.isNotNull(), F.lit(0).cast("decimal(20,0)"))).otherwise(number) if part else number


def with_ids(rows: DataFrame) -> DataFrame:
    """rows with __ms and __seq, the two numbers of stream_id."""
    return rows.withColumn("__ms", stream_id_part(F.col("stream_id"), 0)).withColumn("__seq", stream_id_part(F.col("stream_id"), 1))


def held_by_several(rows: DataFrame, key: Sequence[str] = ("snap_id", "db", "key"), file: str = "file_id") -> DataFrame:
    """(key, id_ms, id_seq, n_rows) of entries with rows in two or more files.

    Ids are compared as their two numbers. Rows without a readable id belong to no entry; a null file is no file. Null
    key columns are values like any other. Other columns are not read.
    """
    picked = rows.select(*[f"`{c}`" for c in key], "stream_id", F.col(f"`{file}`").alias("__file"))
    entries = with_ids(picked).where(F.col("__ms").isNotNull() & F.col("__seq").isNotNull())
    held = entries.groupBy(*[f"`{c}`" for c in key], "__ms", "__seq").agg(F.min("__file").alias("__a"), F.max("__file").alias("__b"), F.count(F.lit(1)).alias("n_rows"))
    return held.where(F.col("__a") != F.col("__b")).select(*[f"`{c}`" for c in key], F.col("__ms").alias("id_ms"), F.col("__seq").alias("id_seq"), "n_rows")


def exactly_once(rows: DataFrame, key: Sequence[str] = ("snap_id", "db", "key"), file: str = "file_id") -> DataFrame:
    """(key, id_ms, id_seq, field, field_value, all other columns): every entry once, whole.

    Of each field and value of an entry as many rows come out as the file that has most of them holds, so copies in
    several files collapse, a part of an entry is completed by the others, and a field that occurs twice in one entry
    stays twice. A stream without entries, and rows without a readable id, come out by the same rule with null ids.

    Copies of a row may differ in the other columns, those of the id's spelling and the file among them; their values
    then are those of one copy, the least by file, stream_id and the other columns in their order, null before all. A
    column named id_ms or id_seq comes out as row_id_ms or row_id_seq. Null key columns are values like any other.
    """
    taken = {*key, "field", "field_value"}
    others = [file, "stream_id", *[c for c in rows.columns if c not in taken and c not in (file, "stream_id")]]
    ids = [f"__k{i}" for i in range(len(key))]
    picked = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(key, ids)], F.col("field").alias("__f"), F.col("field_value").alias("__v"), stream_id_part(F.col("stream_id"), 0).alias("__ms"), stream_id_part(F.col("stream_id"), 1).alias("__seq"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("__row"))
    by = [*ids, "__ms", "__seq", "__f", "__v"]
    per_file = picked.groupBy(*by, F.col("__row.c0").alias("__file")).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__row"))
    most = per_file.groupBy(*by).agg(F.max("__n").alias("__n"), F.min("__row").alias("__row"))
    once = most.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    named = [F.col(f"__row.c{i}").alias(f"row_{c}" if c in ("id_ms", "id_seq") else c) for i, c in enumerate(others)]
    return once.select(*[F.col(i).alias(c) for c, i in zip(key, ids)], F.col("__ms").alias("id_ms"), F.col("__seq").alias("id_seq"), F.col("__f").alias("field"), F.col("__v").alias("field_value"), *named)


def compact_entries(spark: SparkSession, path: str, out_dir: str | None = None, target_bytes: int = TARGET_BYTES, key: Sequence[str] = ("snap_id", "db", "key"), file: str = "file_id") -> tuple[str, DataFrame]:
    """Tiny files under path into few files in out_dir that hold every entry exactly once; (folder, compact_files' report).

    The files are joined by their blocks first, so that what is read to resolve the copies are few files; the resolved
    rows are written in about as many files as the joined ones have target_bytes. An entry's rows lie in one file, a
    stream's in as many as its entries.
    """
    joined, report = compact_files(spark, path, target_bytes=target_bytes)
    folder = out_dir or fresh_path(spark, "entries")
    size = report.agg(F.sum("n_bytes")).first()[0] or 0
    if report.isEmpty():
        return folder, report
    once = exactly_once(spark.read.parquet(joined), key, file)
    once.repartition(max(1, -(-size // target_bytes)), *[f"`{c}`" for c in key], "id_ms", "id_seq").write.mode("overwrite").parquet(folder)
    return folder, report

"""What every operator needs from the session: the shared folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of at most this many rows and bytes may be broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20

_shipped: set[str] = set()
_local_dirs: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for package in ("keyquarry", "testkit"):
            for base, _, names in os.walk(os.path.join(root, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(base, name)
                        z.write(full, os.path.relpath(full, root))
    path = os.path.join(tempfile.mkdtemp(prefix="keyquarry-ship-"), "keyquarry_ship.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)  # the driver serves it; executors fetch it
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where the setting is absent, local mode gets a folder of its own; a cluster without the setting is an error, as a
    machine-local folder would lose rows there.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        path = sc._jvm.org.apache.hadoop.fs.Path(told)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='keyquarry-shared-')}"
    return _local_dirs[sc.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and every executor can read it again.

    Used where a plan would otherwise be evaluated twice, or where values such as generated ordinals must not change
    when a lost task is run again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: text and bytes by their length, all else 8 or, nested, the length as JSON."""
    sizes = [F.lit(16 * len(df.columns) + 1)]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("c")))), F.lit(0)))
    return reduce(lambda a, b: a + b, (s.cast("bigint") for s in sizes))


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has at most `rows` rows (BROADCAST_ROWS) and BROADCAST_BYTES; reads no more than rows + 1 of them."""
    most = BROADCAST_ROWS if rows is None else rows
    n, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return n <= most and (size or 0) <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is found to be small, else df as it is, for a shuffled join with AQE's skew split."""
    return F.broadcast(df) if is_small(df, rows) else df


def small_table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df evaluated once, for what several joins use: with a broadcast hint if it is small. It is written to the shared
    folder; only a small one comes to the driver, when it is broadcast."""
    written = materialize(df, "small")
    return small_side(written, rows)


def local_table(spark: SparkSession, rows: pa.Table, schema: T.StructType | str) -> DataFrame:
    """Rows as part of the plan, of a size that Spark knows."""
    return spark.createDataFrame(rows, schema)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work in Python on few files; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Join on equal names where null equals null; the right side's copies of the names are dropped."""
    r = right.select([F.col(f"`{c}`").alias(f"__r_{c}") if c in names else F.col(f"`{c}`") for c in right.columns])
    cond = None
    for c in names:
        one = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = one if cond is None else cond & one
    joined = left.join(r, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{c}" for c in names])


def utf8(column) -> Column:
    """Text of a binary column; bytes that aren't UTF-8 become U+FFFD."""
    return F.make_valid_utf8(column.cast("string"))

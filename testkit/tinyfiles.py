"""The append-log table as the very many tiny Parquet files that it was delivered in, one per file_id."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyquarry.runtime import fresh_path, ship
from keyquarry.sources.parquetblocks import open_fs

#: Files that one task writes, about; a folder holds one task's.
FILES_PER_TASK = 2000

_built: dict[tuple[str, str], str] = {}


def write_tiny(rows: DataFrame, ids: DataFrame, folder: str, file: str = "file_id") -> None:
    """A file per id of ids, with the rows of that id; one without rows is written, too."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, ids.count() // FILES_PER_TASK)
    whole = ids.select(F.col(file).alias("__id")).join(rows, F.col("__id") == F.col(file), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), schema)
        filesystem, name = open_fs(f"{folder}/{TaskContext.get().partitionId():05d}")
        filesystem.create_dir(name, recursive=True)
        at, n, body = 0, table.num_rows, table.drop_columns(["__id"])
        for run in pc.run_end_encode(table["__id"].combine_chunks()).run_ends.to_pylist() if n else []:
            part = body.slice(at, run - at)
            if part.num_rows == 1 and part[file][0].as_py() is None:  # an id without rows
                part = part.slice(0, 0)
            pq.write_table(part, f"{name}/{table['__id'][at].as_py()}.parquet", filesystem=filesystem)
            at = run
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(whole.schema)
    whole.repartition(tasks, "__id").sortWithinPartitions("__id").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def build(spark: SparkSession, sf_dir: str) -> str:
    """The folder with kv_stream's tiny files, and empty ones for the other files of stream_file; built once per
    application and tables."""
    ship(spark)
    known = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if known not in _built:
        rows, files = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("kv_stream", "stream_file"))
        folder = fresh_path(spark, "tiny")
        write_tiny(rows, rows.select("file_id").union(files.select("file_id")).distinct(), folder)
        _built[known] = folder
    return _built[known]

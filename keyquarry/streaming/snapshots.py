"""Snapshots as they arrive in a folder, appended to tables by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.schemas import HEURISTICS
from ..operators.tables import PART_BYTES, read_entries, tables
from ..runtime import ship


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.rdb", files_per_batch: int = 100) -> DataFrame:
    """A stream of (path, length, modificationTime) of new files; their bytes aren't read here."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return source.load(folder).select("path", "length", "modificationTime")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, types: set[str] | None = None, heuristics: frozenset[str] = frozenset(HEURISTICS), once: bool = False, interval: str = "1 minute", pattern: str = "*.rdb", files_per_batch: int = 100, **options) -> StreamingQuery:
    """Decode every snapshot that arrives in folder, once, into out/{type}.parquet, partitioned by batch.

    A batch that is tried again after a failure overwrites its own partition, so its rows are there once. Only the paths
    of a batch, files_per_batch at most, pass through the driver. A damaged snapshot stops the stream; the batch stays
    undone. With once, what is there is worked off and the query ends.
    """
    ship(spark)

    def work(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").orderBy("path").collect()]
        if not paths:
            return
        entries = read_entries(spark, ",".join(paths), **{"partBytes": PART_BYTES} | options).persist()
        try:
            for kind, df in tables(entries, types, heuristics, order=True).items():
                df.write.mode("overwrite").parquet(f"{out}/{kind}.parquet/batch={number}")
        finally:
            entries.unpersist()

    writer = arrivals(spark, folder, pattern, files_per_batch).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def expiring(table: DataFrame, horizon_ms: int, now_ms: int) -> DataFrame:
    """Rows of a batch or streaming table whose key expires within the horizon; rows already past are there, too."""
    return table.where(F.col("expiry_ms") <= F.lit(now_ms + horizon_ms))

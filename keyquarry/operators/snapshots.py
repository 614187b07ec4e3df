"""The order of a node's periodic snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_snapshots(files: DataFrame) -> DataFrame:
    """(node_id, snap_id, taken_at, ord) of the snapshots that count.

    Files that broke off (complete isn't true) don't count; nor do files without node_id, taken_at or snap_id, which
    have no place in the order. Files with the same node_id and taken_at count once, as the one of lowest snap_id.
    ord numbers a node's snapshots from 0 by taken_at.
    """
    kept = (
        files.select("node_id", "snap_id", "taken_at", "complete")
        .where(F.col("complete") & F.col("node_id").isNotNull() & F.col("taken_at").isNotNull() & F.col("snap_id").isNotNull())
        .groupBy("node_id", "taken_at")
        .agg(F.min("snap_id").alias("snap_id"))
    )
    order = Window.partitionBy("node_id").orderBy("taken_at")
    return kept.select("node_id", "snap_id", "taken_at", (F.row_number().over(order) - 1).cast("int").alias("ord"))


def latest_snapshots(files: DataFrame) -> DataFrame:
    """(node_id, snap_id) of every node's last snapshot that counts."""
    return usable_snapshots(files).groupBy("node_id").agg(F.max_by("snap_id", "ord").alias("snap_id"))

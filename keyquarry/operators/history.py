"""History of changing attributes from periodic snapshots, by tree-reduction coalescing.

Every snapshot that holds a payload is a unit interval [ord, ord + 1) of the node's snapshots. Round r looks at blocks
of 2^r snapshots and joins the run that ends at a block's middle to the run that begins there, so that after
ceil(log2(snapshots)) rounds every run is as long as it can be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_table
from .snapshots import usable_snapshots

#: Snapshots whose presence one 64-bit word holds; rounds within a word need no further shuffle.
WORD = 64


def coalesce_round(runs: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """One round: join neighbouring runs (start, end) across the middle of each block of `size` snapshots."""
    half = size // 2
    block = F.floor(F.col("start") / size)
    left = F.col("end") == block * size + half
    right = F.col("start") == block * size + half
    tagged = runs.select(*by, "start", "end", block.alias("__block"), F.when(left | right, F.lit(-1)).otherwise(F.col("start")).alias("__tag"))
    return tagged.groupBy(*by, "__block", "__tag").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*by, "start", "end")


def version_runs(rows: DataFrame, files: DataFrame, entity: Sequence[str] = ("db", "key", "field"), payload: Sequence[str] = ("value", "expiry_ms"), present: str = "field") -> DataFrame:
    """One row per version: node_id, entity, payload, from_snap_id, until_snap_id (null while it still holds).

    A version is a longest run of consecutive counting snapshots of a node that all hold the entity with the same
    payload; null payload columns equal each other. Rows whose `present` column is null (empty hashes) hold nothing.
    Repeated rows change nothing; if a snapshot holds an entity with two payloads, both are versions of it. Snapshots
    that don't count, or aren't listed in files, are passed over. Other columns are not read. Empty in, empty out.

    The rows are shuffled once: presence is packed into a bit per snapshot with map-side OR, keyed by entity, payload
    and word of 64 snapshots, and rounds up to 64 keep that partitioning. Only a node of more than 64 snapshots needs
    one more shuffle, of its runs.
    """
    index = small_table(usable_snapshots(files))
    count = index.agg(F.max("ord")).first()[0]
    last = -1 if count is None else count
    by_columns = [*entity, *payload]
    held = rows.where(F.col(f"`{present}`").isNotNull()).select(F.col("snap_id").alias("__snap"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(by_columns)])
    placed = held.join(index.select(F.col("snap_id").alias("__snap"), F.col("node_id").alias("__node"), F.col("ord").alias("__ord")), "__snap")
    by = ["__node", *[f"__c{i}" for i in range(len(by_columns))]]
    words = placed.groupBy(*by, F.floor(F.col("__ord") / WORD).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, __ord % {WORD})")).alias("__bits"))
    places = F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright(__bits, i) & 1L) = 1L)")
    runs = words.select(*by, "__word", F.explode(places).alias("__i"))
    start = (F.col("__word") * WORD + F.col("__i")).cast("bigint")
    runs = runs.select(*by, "__word", start.alias("start"), (start + 1).alias("end"))
    size = 2
    while size <= WORD and size < 2 * (last + 1):
        runs = coalesce_round(runs, [*by, "__word"], size)
        size *= 2
    runs = runs.drop("__word")
    while size < 2 * (last + 1):
        runs = coalesce_round(runs, by, size)
        size *= 2
    at = lambda n, o, s: index.select(F.col("node_id").alias(n), F.col("ord").cast("bigint").alias(o), F.col("snap_id").alias(s))
    first = runs.join(at("__node", "start", "from_snap_id"), ["__node", "start"])
    both = first.join(at("__node", "end", "until_snap_id"), ["__node", "end"], "left")
    return both.select(F.col("__node").alias("node_id"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(by_columns)], "from_snap_id", "until_snap_id")

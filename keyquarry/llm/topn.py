"""The N highest-scoring items of every group, by descending score bands.

Groups of many rows are worked in bands of scores, from the top: the first band's lower end is placed so that about as many
rows lie above it as fill all such groups, each later band holds eight times as many. Groups that have N items are
anti-joined away, so most rows of large groups are never shuffled; groups left short carry what they have into the next
band. The last band takes what is left. A band holds all equal scores, so ranking ties within it is exact. Small groups
are ranked whole, each in one task after one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, null_safe, small_side, small_table

#: A group of more than so many rows for each item that is kept is worked in bands.
LARGE = 64
#: Rows above the first band's lower end for each item to keep of the large groups; each later band holds WIDER times as
#: many as all bands before it.
FIRST, WIDER = 4, 8
#: No band ends below this share of the large groups' rows: the rest is the last band.
LAST = 0.5
#: Ranks are exact within this part of the rows when the bands' ends are sought; they only decide how wide bands are.
ACCURACY = 100_000


def band_ends(rows: DataFrame, n: int, groups: int, total: int) -> list[float]:
    """Lower ends of the bands from the top down, at quantiles of the rows' finite scores; none where one band will do."""
    shares, share = [], FIRST * n * groups / max(total, 1)
    while share < LAST:
        shares.append(share)
        share *= WIDER
    if not shares:
        return []
    finite = rows.where(F.abs("__score") < F.lit(float("inf")))
    cuts = finite.agg(F.percentile_approx("__score", [1 - s for s in shares], ACCURACY)).first()[0]
    return sorted(set(cuts or []), reverse=True)


def top_n(rows: DataFrame, n: int, group: Sequence[str], item: str, score: str, large: int = LARGE) -> DataFrame:
    """(group columns, pos, item, score): per group the n items of highest score, pos 1 to n.

    An item given more than once counts once, with its highest score. Null and NaN scores and null items don't count;
    -0.0 equals 0.0; infinities rank. Equal scores rank by item, ascending (bytes, for binary). A group with fewer items
    gives what it has, one without any no row. Null group columns are values like any other. Other columns are not read.

    The rows are read once for their number by group, and once for the groups of up to large * n rows. If there are
    larger ones, they are read once for the bands' ends and once for each band; rows of a band are combined by (group,
    item) before a shuffle, and of what a task then has of a group n rows at most go on. Lists of groups are broadcast
    if they are small (runtime), else joined by a shuffle, in which Spark splits the partitions of hot groups.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    ids = [f"__g{i}" for i in range(len(group))]
    plain = F.when(F.col(f"`{score}`") == 0, F.lit(0.0)).otherwise(F.col(f"`{score}`").cast("double"))
    picked = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(group, ids)], F.col(f"`{item}`").alias("__item"), plain.alias("__score"))
    picked = picked.where(F.col("__item").isNotNull() & F.col("__score").isNotNull() & ~F.isnan("__score"))
    order = Window.partitionBy(*ids).orderBy(F.col("__score").desc(), F.col("__item"))

    def ranked(band: DataFrame) -> DataFrame:
        best = band.groupBy(*ids, "__item").agg(F.max("__score").alias("__score"))
        # Catalyst keeps n rows of a group per task before the shuffle (window group limit).
        return best.withColumn("__pos", F.row_number().over(order)).where(F.col("__pos") <= n)

    many = small_table(picked.groupBy(*ids).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > large * n))
    groups, total = many.agg(F.count(F.lit(1)), F.sum("__rows")).first()
    ends = band_ends(null_safe(picked, many.drop("__rows"), ids, "left_semi"), n, groups, total) if groups else []
    done: list[DataFrame] = []
    open_groups, carried, above = many.drop("__rows"), None, None
    for low in ends:
        band = null_safe(picked.where(F.col("__score") >= low), open_groups, ids, "left_semi")
        if above is not None:
            band = band.where(F.col("__score") < above)
        if carried is not None:
            band = band.unionByName(carried)
        held = materialize(ranked(band).withColumn("__full", F.count(F.lit(1)).over(Window.partitionBy(*ids)) == n), "band")
        done.append(held.where("__full").drop("__full"))
        open_groups = small_table(null_safe(open_groups, done[-1].where(F.col("__pos") == n).select(*ids), ids, "left_anti"))
        carried = held.where("NOT __full").select(*ids, "__item", "__score")
        above = low
        if open_groups.isEmpty():
            break
    if groups and not open_groups.isEmpty():  # what lies above the last end is carried
        rest = null_safe(picked if above is None else picked.where(F.col("__score") < above), open_groups, ids, "left_semi")
        done.append(ranked(rest if carried is None else rest.unionByName(carried)))
    small = null_safe(picked, many.drop("__rows"), ids, "left_anti") if groups else picked
    done.append(ranked(small.repartition(*ids)))
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col(i).alias(c) for i, c in zip(ids, group)], F.col("__pos").cast("bigint").alias("pos"), F.col("__item").alias(item), F.col("__score").alias(score))

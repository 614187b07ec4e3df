"""Per-key results where a few keys hold most rows, by value-frequency compression.

Rows are counted by key and value first, so the shuffle splits a hot key over its values; what is derived by key then
works on weighted values: exact distinct counts, modes and percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, null_safe, small_side

#: Bits of a value that one pass of the percentile search tells apart: at most 2^16 counts per key and pass.
DIGIT = 16
LEVELS = 64 // DIGIT


def weighted_values(rows: DataFrame, key: Sequence[str], value: str | Column, name: str = "value", keep_max: Sequence[str] = ()) -> DataFrame:
    """(key, value, weight, and the largest of keep_max): how often each key has each value. Null is a value."""
    v = F.col(f"`{value}`") if isinstance(value, str) else value
    picked = rows.select(*[F.col(f"`{c}`") for c in key], v.alias(name), *[F.col(f"`{c}`").alias(f"__max_{c}") for c in keep_max])
    return picked.groupBy(*[f"`{c}`" for c in key], name).agg(F.count(F.lit(1)).alias("weight"), *[F.max(f"__max_{c}").alias(f"max_{c}") for c in keep_max])


def list_lengths(rows: DataFrame, key: Sequence[str] = ("snap_id", "db", "key")) -> DataFrame:
    """(key, n_rows, true_length, stated_length) of every list.

    true_length is the number of different non-null elem_index, stated_length the largest num_elements (null if none is
    stated). A list whose only rows have a null elem_index is empty: length 0. Null key columns are values like any
    other; an empty table gives no rows; other columns are not read.
    """
    weighted = weighted_values(rows, key, "elem_index", "value", ["num_elements"])
    return weighted.groupBy(*[f"`{c}`" for c in key]).agg(F.sum("weight").alias("n_rows"), F.count("value").alias("true_length"), F.max("max_num_elements").alias("stated_length"))


def modes(weighted: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n_distinct, mode, mode_weight) over non-null values: the most frequent value, the least among equals.

    Keys with only null values have n_distinct 0 and a null mode.
    """
    best = F.max(F.when(F.col("value").isNotNull(), F.col("weight"))).alias("mode_weight")
    tops = weighted.groupBy(*[f"`{c}`" for c in key]).agg(F.count("value").alias("n_distinct"), best, F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v")))).alias("__m"))
    return tops.select(*[f"`{c}`" for c in key], "n_distinct", F.col("__m.v").alias("mode"), "mode_weight")


def percentiles(weighted: DataFrame, key: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(key, fraction, value): exact lower percentiles of whole numbers: the least value with at least
    ceil(fraction * n) rows at or below it (fraction 0: the least value).

    The value is found digit by digit (2^16 counts at most per key and pass), so no key's values meet in one task; after
    the first digit only values whose higher digits are those of a wanted one are counted. Null values don't count; a
    key without values has no row.
    """
    ids = [f"__k{i}" for i in range(len(key))]
    # Flipping the sign bit puts the numbers in the order of unsigned ones, whose digits are then shifted out.
    ordered = F.col("value").cast("bigint").bitwiseXOR(F.lit(-(2**63)))
    source = materialize(weighted.where(F.col("value").isNotNull()).select(*[F.col(f"`{c}`").alias(i) for c, i in zip(key, ids)], ordered.alias("__v"), "weight"), "weighted")
    totals = source.groupBy(*ids).agg(F.sum("weight").alias("__n"))
    want = totals.select(*ids, F.explode(F.array(*[F.lit(float(f)) for f in fractions]).cast("array<double>")).alias("__q"), "__n")
    want = want.select(*ids, "__q", F.greatest(F.lit(1), F.ceil(F.col("__q") * F.col("__n"))).cast("bigint").alias("__rank"), F.lit(0).cast("bigint").alias("__prefix"))
    span = source.agg(F.min("__v"), F.max("__v"), F.min(F.expr("__v < 0")), F.max(F.expr("__v < 0"))).first()
    level = LEVELS - 1
    if span[0] is not None and span[2] == span[3]:  # digits that all values share need no pass
        while level and (span[0] >> level * DIGIT) == (span[1] >> level * DIGIT):
            level -= 1
        if level < LEVELS - 1:
            shared = (span[0] >> (level + 1) * DIGIT) & ((1 << 64 - (level + 1) * DIGIT) - 1)
            want = want.withColumn("__prefix", F.lit(shared).cast("bigint"))
    for at in range(level, -1, -1):
        digit = F.expr(f"shiftrightunsigned(__v, {at * DIGIT}) & {(1 << DIGIT) - 1}L")
        above = F.expr(f"shiftrightunsigned(__v, {(at + 1) * DIGIT})") if at < LEVELS - 1 else F.lit(0).cast("bigint")
        placed = source.select(*ids, above.alias("__prefix"), digit.alias("__d"), "weight")
        if at < level:
            placed = null_safe(placed, small_side(want.select(*ids, "__prefix").distinct()), [*ids, "__prefix"], "left_semi")
        counted = placed.groupBy(*ids, "__prefix", "__d").agg(F.sum("weight").alias("__w"))
        cells = counted.groupBy(*ids, "__prefix").agg(F.sort_array(F.collect_list(F.struct("__d", "__w"))).alias("__cells"))
        joined = want.alias("a").join(cells.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*ids, "__prefix"]])
        # Walk the sorted counts until the rank is reached; d stays null until then.
        walked = F.aggregate(
            "__cells",
            F.struct(F.col("__rank").alias("left"), F.lit(None).cast("bigint").alias("d")),
            lambda acc, x: F.when(acc["d"].isNotNull(), acc).when(acc["left"] <= x["__w"], F.struct(acc["left"].alias("left"), x["__d"].alias("d"))).otherwise(F.struct((acc["left"] - x["__w"]).alias("left"), F.lit(None).cast("bigint").alias("d"))),
        )
        found = joined.select(*[F.col(f"a.{i}").alias(i) for i in ids], "__q", F.col("a.__prefix").alias("__prefix"), walked.alias("__f"))
        want = found.select(*ids, "__q", F.col("__f.left").alias("__rank"), F.expr(f"shiftleft(__prefix, {DIGIT})").bitwiseOR(F.col("__f.d")).alias("__prefix"))
        if at:
            want = materialize(want, "prefixes")
    return want.select(*[F.col(i).alias(c) for i, c in zip(ids, key)], F.col("__q").alias("fraction"), F.col("__prefix").bitwiseXOR(F.lit(-(2**63))).alias("value"))

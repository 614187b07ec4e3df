"""Distinct counts by bit matrices of hash ranks (probabilistic counting with stochastic averaging).

A hash sends a value to one of 2^BUCKETS buckets and, by its trailing zeros, to a rank; the bucket's bit of that rank is
set. A group's matrix is kept as one row per bucket, merging is bitwise OR. The count is estimated by maximum
likelihood over all cells, with the standard deviation from the Fisher information.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import is_small, materialize, null_safe

#: log2 of the buckets: 4096 give a relative standard deviation of about 1 %.
BUCKETS = 12
#: Ranks that a 64-bit hash has beside the bucket's bits.
RANKS = 64 - BUCKETS
#: Standard deviations within which a count is taken to lie.
SURE = 6.0


def sketches(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, bucket, bits, n_rows): each group's matrix, partial results that merge() combines.

    Null values set no bit but their rows count. Null groups are groups. Rows are combined before the shuffle, so a
    group costs a task at most one row per bucket, however many rows it has.
    """
    h = F.xxhash64(F.col(f"`{value}`"))
    picked = rows.select(*[F.col(f"`{g}`") for g in groups], F.when(F.col(f"`{value}`").isNotNull(), h).alias("__h"))
    rest = F.expr(f"shiftrightunsigned(__h, {BUCKETS})")
    bits = F.when(F.col("__h").isNull(), F.lit(0)).when(rest == 0, F.expr(f"shiftleft(1L, {RANKS - 1})")).otherwise(rest.bitwiseAND(F.try_subtract(F.lit(0).cast("bigint"), rest)))
    cell = picked.select(*[f"`{g}`" for g in groups], F.coalesce(F.expr(f"__h & {2**BUCKETS - 1}L"), F.lit(0)).alias("bucket"), bits.alias("bits"))
    return cell.groupBy(*[f"`{g}`" for g in groups], "bucket").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("n_rows"))


def merge(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Matrices of fewer groups, or of several parts, by bitwise OR."""
    return parts.groupBy(*[f"`{g}`" for g in groups], "bucket").agg(F.bit_or("bits").alias("bits"), F.sum("n_rows").alias("n_rows"))


def merge_cube(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Matrices of every combination of groups; `level` is the grouping id, in which a 1 bit marks a group that is all."""
    names = [f"`{g}`" for g in groups]
    sets = [[F.col(c) for i, c in enumerate(names) if not level >> i & 1] + [F.col("bucket")] for level in range(2 ** len(names))]
    merged = parts.groupingSets(sets, *names, "bucket").agg(F.bit_or("bits").alias("bits"), F.sum("n_rows").alias("n_rows"), F.grouping_id().alias("__id"))
    return merged.withColumn("level", F.expr("cast(shiftright(__id, 1) as bigint)")).drop("__id")


def likeliest(set_cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and their standard deviations from rows of set buckets per rank.

    With n values, a cell of rank k is set with probability 1 - exp(-n q), q = 2^-(k+1) / buckets. The derivative of
    the log likelihood falls in n, so its zero is found by bisection.
    """
    m = 2.0**BUCKETS
    k = np.arange(RANKS)
    q = np.where(k < RANKS - 1, 2.0 ** -(k + 1.0), 2.0 ** -(RANKS - 1.0)) / m
    c = set_cells.astype(float)

    def slope(n: np.ndarray) -> np.ndarray:
        return (c * q / np.expm1(np.minimum(n[:, None] * q, 700)) - (m - c) * q).sum(axis=1)

    low, high = np.full(len(c), 1e-3), np.full(len(c), 1e18)
    for _ in range(120):
        mid = np.sqrt(low * high)
        up = slope(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    n = np.where(c.sum(axis=1) == 0, 0.0, np.sqrt(low * high))
    x = np.minimum(np.maximum(n, 1e-3)[:, None] * q, 700)
    information = (m * q * q / np.expm1(x)).sum(axis=1)
    return n, np.where(n > 0, 1 / np.sqrt(information), 0.0)


def estimates(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, n_rows, estimate, deviation, low, high): low and high lie SURE deviations around the estimate."""

    @F.pandas_udf("estimate double, deviation double")
    def estimate(cells: pd.Series) -> pd.DataFrame:
        n, sd = likeliest(np.array(cells.tolist(), dtype=float).reshape(len(cells), RANKS))
        return pd.DataFrame({"estimate": n, "deviation": sd})

    counted = [F.sum(F.expr(f"shiftright(bits, {k}) & 1L")).alias(f"__{k}") for k in range(RANKS)]
    totals = parts.groupBy(*[f"`{g}`" for g in groups]).agg(F.sum("n_rows").alias("n_rows"), *counted)
    known = totals.select(*[f"`{g}`" for g in groups], "n_rows", estimate(F.array(*[f"__{k}" for k in range(RANKS)])).alias("__e"))
    e, sd = F.col("__e.estimate"), F.col("__e.deviation")
    return known.select(*[f"`{g}`" for g in groups], "n_rows", e.alias("estimate"), sd.alias("deviation"), F.greatest(F.lit(0.0), e - SURE * sd).alias("low"), (e + SURE * sd).alias("high"))


def rows_per_value(rows: DataFrame, groups: Sequence[str], value: str, least: float) -> DataFrame:
    """The groups that have at least `least` rows per different value.

    Where the estimate's bounds leave no doubt they decide; only the rows of groups in doubt are counted exactly, by
    (group, value) first, so that no group meets in one task. A group with null values only has no value and is found.
    """
    names = [f"`{g}`" for g in groups]
    known = materialize(estimates(sketches(rows, groups, value), groups), "estimates")
    sure = known.where(F.col("n_rows") >= least * F.col("high")).select(*names)
    doubt = known.where((F.col("n_rows") < least * F.col("high")) & (F.col("n_rows") >= least * F.col("low"))).select(*names)
    each = rows.select(*names, F.col(f"`{value}`").alias("__v"))
    few = is_small(doubt)
    if few:
        each = null_safe(each, F.broadcast(doubt), groups, "left_semi")
    counted = each.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n"))
    if not few:  # so many groups that none is large: the join comes after the counts
        counted = null_safe(counted, doubt, groups, "left_semi")
    exact = counted.groupBy(*names).agg(F.sum("__n").alias("__n"), F.count("__v").alias("__d"))
    return sure.unionByName(exact.where(F.col("__n") >= least * F.col("__d")).select(*names))

"""Mix sources to target weights by hierarchical budgeting.

Weights are propagated down a tree (for example domain, language, source). A node whose sources can't supply its budget,
however often they may be repeated, leaves its shortage to its siblings first and only then to its ancestors' siblings.
Each leaf then gives whole epochs of its texts and, for the rest of its budget, a prefix of one more seeded epoch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import small_side

#: The most leaves a plan may have; the plan is made on the driver.
LEAVES = 100_000
#: Texts that one part of an epoch's hash order holds, about; only the part where the budget ends is ranked.
PART_ROWS = 50_000


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]
    weight: float
    max_repeats: int
    tokens: int

    @property
    def capacity(self) -> int:
        return self.max_repeats * self.tokens


def allocate(leaves: Sequence[Leaf], total: float) -> dict[tuple[str, ...], float]:
    """Budget of each leaf's path. A node's weight among its siblings is the sum of its leaves' weights.

    Budgets never exceed capacities; they add up to total unless the capacity of all weighted leaves is less.
    """
    if len(leaves) > LEAVES:
        raise ValueError(f"more than {LEAVES} leaves")
    budgets: dict[tuple[str, ...], float] = {}

    def share(group: Sequence[Leaf], depth: int, amount: float) -> None:
        if len(group) == 1 and len(group[0].path) <= depth:
            budgets[group[0].path] = min(amount, float(group[0].capacity))
            return
        children: dict[str, list[Leaf]] = {}
        for leaf in group:
            children.setdefault(leaf.path[depth], []).append(leaf)
        weight = {c: sum(x.weight for x in xs) for c, xs in children.items()}
        room = {c: float(sum(x.capacity for x in xs if x.weight > 0)) for c, xs in children.items()}
        given = dict.fromkeys(children, 0.0)
        open_ones, left = {c for c in children if weight[c] > 0}, amount
        while open_ones and left > 0:
            unit = left / sum(weight[c] for c in open_ones)
            full = {c for c in open_ones if room[c] <= unit * weight[c]}
            if not full:
                for c in open_ones:
                    given[c] = unit * weight[c]
                break
            for c in full:
                given[c] = room[c]
                left -= room[c]
            open_ones -= full
        for c, xs in children.items():
            share(xs, depth + 1, given[c])

    if leaves:
        share(leaves, 0, total)
    return budgets


def read_leaves(sizes: DataFrame, targets: DataFrame, path: Sequence[str]) -> list[Leaf]:
    """The tree's leaves from targets (path columns, weight, max_repeats) and the sizes of texts (path columns, n_tokens).

    Null or negative weights are 0, a null max_repeats is 1, a negative one 0. A path given more than once has the sum of
    its weights and the largest max_repeats. Targets with a null in their path name no source. A target without texts
    has no tokens; texts without a target aren't drawn from.
    """
    names = [f"`{c}`" for c in path]
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    wanted = targets.where(whole).groupBy(*names).agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("__w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("__r"))
    have = sizes.groupBy(*names).agg(F.sum("n_tokens").alias("__t"))
    rows = wanted.join(have, list(path), "left").orderBy(*names).take(LEAVES + 1)
    if len(rows) > LEAVES:
        raise ValueError(f"more than {LEAVES} leaves")
    return [Leaf(tuple(r[c] for c in path), r["__w"], int(r["__r"]), int(r["__t"] or 0)) for r in rows]


def plan(leaves: Sequence[Leaf], total: int) -> list[dict]:
    """Each leaf with its share of weight, target (share of total), budget, and whether it falls short: its budget is all
    that it has, and below its share."""
    weights = math.fsum(x.weight for x in leaves)
    budgets = allocate(leaves, float(total))
    out = []
    for x in leaves:
        share, given = x.weight / weights if weights else 0.0, budgets[x.path]
        out.append({"leaf": x, "share": share, "target": share * total, "short": given >= x.capacity and given < share * total, "budget": int(given)})
    return out


def draw(sizes: DataFrame, planned: Sequence[dict], path: Sequence[str], key: str = "doc_id", seed: int = 0) -> DataFrame:
    """(key, path columns, n_tokens, times): how often each text is used; texts used 0 times have no row.

    sizes has one row per text. A leaf of budget b and t tokens uses every text floor(b / t) times, and once more the
    texts of the longest prefix of its seeded hash order whose tokens fit the rest, so it never exceeds its budget nor
    its repeats. The prefix is found from sums over parts of the hash order; only the part in which it ends is ranked.
    """
    spark = sizes.sparkSession
    names = [f"`{c}`" for c in path]
    rows = [(*p["leaf"].path, p["budget"] // p["leaf"].tokens, p["budget"] % p["leaf"].tokens) for p in planned if p["leaf"].tokens and p["budget"] > 0]
    schema = ", ".join([*[f"`{c}` string" for c in path], "__epochs bigint", "__rest bigint"])
    budget = spark.createDataFrame(rows, schema)
    most = sizes.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
    bits = min(24, max(4, math.ceil(math.log2(most / PART_ROWS)) if most > PART_ROWS else 4))
    hashed = sizes.select(F.col(f"`{key}`").alias("__key"), *names, "n_tokens", F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("__h"))
    joined = hashed.join(small_side(budget), list(path)).withColumn("__part", F.expr(f"shiftrightunsigned(__h, {64 - bits})"))
    parts = joined.groupBy(*names, "__part").agg(F.sum("n_tokens").alias("__n"))
    before = parts.select(*names, "__part", (F.sum("__n").over(Window.partitionBy(*names).orderBy("__part")) - F.col("__n")).alias("__before"), "__n")
    placed = joined.join(small_side(before), [*path, "__part"])
    whole = placed.where(F.col("__before") + F.col("__n") <= F.col("__rest")).withColumn("__more", F.lit(1))
    past = placed.where(F.col("__before") >= F.col("__rest")).withColumn("__more", F.lit(0))
    edge = placed.where((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__n") > F.col("__rest")))
    running = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("__h", "__key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("__more", F.when(F.col("__before") + running <= F.col("__rest"), 1).otherwise(0))
    # A part without tokens at the very end of the budget is past and whole alike; whole ones come first.
    past = past.where(F.col("__before") + F.col("__n") > F.col("__rest"))
    used = whole.unionByName(past).unionByName(edge)
    return used.select(F.col("__key").alias(key), *names, "n_tokens", (F.col("__epochs") + F.col("__more")).alias("times")).where("times > 0")

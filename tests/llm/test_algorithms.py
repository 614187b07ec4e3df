"""Top items per group and distinct counts against plain Python."""

import collections
import math
import random

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyquarry import runtime
from keyquarry.llm import distinct, queries, topn

SCHEMA = "g string, item binary, score double, pos string, __item string"


def brute(rows, n):
    best = collections.defaultdict(dict)
    for g, item, s, *_ in rows:
        if item is not None and s is not None and not math.isnan(s):
            s = s + 0.0
            best[g][item] = max(s, best[g].get(item, -math.inf))
    return {(g, i + 1, m, 0.0 if s == 0 else s) for g, ms in best.items() for i, (m, s) in enumerate(sorted(ms.items(), key=lambda x: (-x[1], x[0]))[:n])}


def ranked(df, n, **kw):
    return {(r["g"], r["pos"], bytes(r["item"]), r["score"]) for r in topn.top_n(df, n, ["g"], "item", "score", **kw).collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_top_n(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    random.seed(1)
    special = [math.nan, math.inf, -math.inf, -0.0, 0.0, None, 3.0, 3.0]
    rows = [(random.choice(["hot"] * 6 + ["a", "b", None, "c"]), random.choice([b"", b"\xff", b"m%d" % random.randint(0, 60)]), random.choice([*special, random.uniform(-9, 9), float(random.randint(0, 4))])) for _ in range(3000)]
    rows += [("few", b"x", 1.0), ("few", b"x", 2.0), ("none", None, None), ("nan", b"y", math.nan), ("low", b"z", -1e300)]
    rows += [("deep", b"d%d" % (i % 4), -1e6 - i) for i in range(2000)]  # too few items to be filled by any band
    rows += [("ties", b"t%04d" % i, 9.5) for i in range(900)]
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], SCHEMA)
    for n, large in ((5, 64), (5, 2), (1, 1)) if broadcast else ((5, 10),):
        assert ranked(df, n, large=large) == brute(rows, n)


def test_bands(spark):
    """Where groups are large there are several bands, which narrow towards the top; most rows lie in none of them."""
    df = spark.range(100_000).select((F.col("id") % 20).alias("g"), F.col("id").cast("double").alias("__score"))
    ends = topn.band_ends(df, 5, 20, 100_000)
    above = [df.where(F.col("__score") >= e).count() for e in ends]
    assert len(ends) == 3 and above[0] == pytest.approx(400, rel=0.1) and above[1] == pytest.approx(3200, rel=0.1) and above[2] == pytest.approx(25600, rel=0.1)
    assert topn.band_ends(df, 5, 20_000, 100_000) == []


def test_top_n_equal_scores_and_empty(spark):
    rows = [("g", b"%04d" % i, 1.0) for i in range(200)]
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], SCHEMA)
    assert ranked(df, 5) == brute(rows, 5)
    assert ranked(df.limit(0), 5) == set()
    assert ranked(df.withColumn("score", F.lit(None).cast("double")), 5) == set()
    assert ranked(df.withColumn("score", F.lit(math.inf)), 2) == {("g", 1, b"0000", math.inf), ("g", 2, b"0001", math.inf)}
    with pytest.raises(ValueError):
        topn.top_n(df, 0, ["g"], "item", "score")


@pytest.mark.parametrize("n", [1, 3, 50, 1_000, 40_000, 1_000_000])
def test_estimate_within_bounds(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("string").cast("binary").alias("v"))
    r = distinct.estimates(distinct.sketches(rows, ["g"], "v"), ["g"]).first()
    assert r["low"] <= n <= r["high"] and r["n_rows"] == n
    assert abs(r["estimate"] - n) <= max(1, 0.05 * n)
    if n >= 40_000:
        assert r["deviation"] < 0.012 * n


def test_parts_combine(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("d"), (F.col("id") % 2).alias("t"), (F.col("id") % 9_000).cast("string").alias("v"))
    whole = distinct.sketches(rows, ["d"], "v")
    parts = distinct.sketches(rows.where("d < 2"), ["d", "t"], "v").unionByName(distinct.sketches(rows.where("d >= 1"), ["d", "t"], "v"))
    merged = distinct.merge(parts, ["d"])
    bits = lambda df: {(r["d"], r["bucket"]): r["bits"] for r in df.collect()}
    assert bits(whole) == bits(merged)
    cube = {(r["d"], r["t"], r["level"]): r for r in distinct.estimates(distinct.merge_cube(distinct.sketches(rows, ["d", "t"], "v"), ["d", "t"]), ["d", "t", "level"]).collect()}
    assert len(cube) == 6 + 3 + 2 + 1
    assert cube[(None, None, 3)]["low"] <= 9_000 <= cube[(None, None, 3)]["high"] and cube[(None, None, 3)]["n_rows"] == 30_000
    assert cube[(1, None, 1)]["low"] <= 3_000 <= cube[(1, None, 1)]["high"]


def test_likeliest_is_unbiased():
    rng = np.random.default_rng(0)
    m = 2**distinct.BUCKETS
    found = []
    for _ in range(40):
        h = rng.integers(0, 2**63, 50_000, dtype=np.int64)
        bucket, rest = h % m, h // m
        rank = np.minimum(np.log2((rest & -rest).astype(float)).astype(int), distinct.RANKS - 1)
        cells = np.zeros((m, distinct.RANKS), bool)
        cells[bucket, rank] = True
        n, sd = distinct.likeliest(cells.sum(axis=0, keepdims=True))
        found.append((n[0] - 50_000) / sd[0])
    assert abs(np.mean(found)) < 0.6 and 0.6 < np.std(found) < 1.4


def test_rows_per_value(spark):
    random.seed(2)
    rows = [("twice", f"k{i}") for i in range(3000) for _ in range(2)] + [("less", f"k{i}") for i in range(3000) for _ in range(2)][:-1] + [("once", f"k{i}") for i in range(5000)]
    rows += [("much", f"k{i % 10}") for i in range(500)] + [(None, "x"), (None, "x"), ("nulls", None), ("mixed", None), ("mixed", "a"), ("one", "a")]
    df = spark.createDataFrame(rows, "g string, v string").withColumn("bucket", F.lit(1)).withColumn("bits", F.lit("x"))
    got = {r["g"] for r in distinct.rows_per_value(df, ["g"], "v", 2.0).collect()}
    assert got == {"twice", "much", None, "nulls", "mixed"}
    assert distinct.rows_per_value(df.limit(0), ["g"], "v", 2.0).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    columns, named, got, want = compare.both(spark, queries.QUERIES[name], queries.SQL[name], f"{compare.DATA}/sf0.001")
    assert columns == named and got == want and got


def test_counts_hold_the_truth(spark):
    sf = f"{compare.DATA}/sf0.001"
    sql = "SELECT strftime(taken_at, '%Y-%m-%d') AS d, s.db, s.type, count(DISTINCT s.key), count(*) FROM kv_string s JOIN snapshot_file f USING (snap_id) GROUP BY CUBE (1, 2, 3)"
    want = {(r[0], r[1], r[2]): r[3:] for r in compare.connect(sf).execute(sql).fetchall()}
    rows = queries.p4_counts(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, c = want[(r["snap_day"], r["db"], r["type"])]
        assert r["low"] <= n <= r["high"] and r["n_rows"] == c

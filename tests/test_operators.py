"""The general operators against plain Python, on tables with nulls, repeats, clashing names and hot keys."""

import collections
import datetime
import decimal
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keyquarry.operators import compaction, history, skewstats, snapdiff, snapshots, widetable
from keyquarry.runtime import shared_dir
from keyquarry.sources import parquetblocks, parquetpages

T0 = datetime.datetime(2024, 1, 1)
FILES = "snap_id bigint, node_id bigint, taken_at timestamp, complete boolean, ord string, __snap string"


def files_of(spark, n_nodes=3, n_snaps=9, seed=0):
    """Snapshot files with gaps, repeats of one time, incomplete and unplaced ones."""
    rnd, rows = random.Random(seed), []
    snap = 0
    for t in range(n_snaps):
        for node in range(n_nodes):
            for _ in range(rnd.choice([0, 1, 1, 1, 2])):
                snap += 1
                rows.append((snap, node, T0 + datetime.timedelta(days=t), rnd.random() > 0.2, "o", "s"))
    rows += [(snap + 1, None, T0, True, "o", "s"), (snap + 2, 0, None, True, "o", "s"), (snap + 3, 0, T0, None, "o", "s")]
    rnd.shuffle(rows)
    order = {}
    for s, node, at, whole, *_ in sorted(rows, key=lambda r: r[0]):
        if whole and node is not None and at is not None:
            order.setdefault(node, {}).setdefault(at, s)
    return spark.createDataFrame(rows, FILES), {node: [snaps[at] for at in sorted(snaps)] for node, snaps in order.items()}, snap + 3


def test_snapshots(spark):
    df, order, _ = files_of(spark)
    got = collections.defaultdict(dict)
    for r in snapshots.usable_snapshots(df).collect():
        got[r["node_id"]][r["ord"]] = r["snap_id"]
    assert {n: [d[i] for i in sorted(d)] for n, d in got.items()} == order
    assert {(r["node_id"], r["snap_id"]) for r in snapshots.latest_snapshots(df).collect()} == {(n, s[-1]) for n, s in order.items()}
    assert snapshots.usable_snapshots(df.limit(0)).collect() == []


# Wide table

SPEC = [("age", "int"), ("score", "double"), ("is_on", "bool"), ("seen_at", "ts"), ("name", "string"), ("db", "int")]
CELLS = [
    ("age", "42", 42), ("age", " +42 ", 42), ("age", "-1,234,567", -1234567), ("age", "7.00", 7), ("age", "9223372036854775807", 2**63 - 1), ("age", "-9223372036854775808", -(2**63)), ("age", "0042", 42),
    ("age", "9223372036854775808", None), ("age", "4.5", None), ("age", "1,23", None), ("age", "12a", None), ("age", "0x1", None), ("age", "1_0", None), ("age", "--1", None), ("age", "", None), ("age", "N/A", None), ("age", "∞", None), ("age", "٣", None), ("age", "5.", None),
    ("score", "1.5", 1.5), ("score", "-.5", -0.5), ("score", "1e3", 1000.0), ("score", "2.E-1", 0.2), ("score", "7", 7.0), ("score", "1e999", None), ("score", "NaN", None), ("score", "inf", None), ("score", ".", None), ("score", "e5", None), ("score", "1e", None), ("score", "1.5f", None), ("score", "1,5", None), ("score", "$1", None),
    ("is_on", "TRUE", True), ("is_on", "t", True), ("is_on", "Yes", True), ("is_on", "on", True), ("is_on", "1", True), ("is_on", "oFF", False), ("is_on", "N", False), ("is_on", "0", False), ("is_on", "2", None), ("is_on", "tr", None), ("is_on", "-", None),
    ("seen_at", "1700000000", 1700000000), ("seen_at", "1700000000123", 1700000000.123), ("seen_at", "2023-11-14", 1699920000), ("seen_at", "2023-11-14T22:13:20Z", 1700000000), ("seen_at", "2023-11-14 22:13:20", 1700000000), ("seen_at", "2023-11-14T22:13:20.5+02:00", 1699992800.5),
    ("seen_at", "2023-11-14T22:13:20-0530", 1700019800), ("seen_at", "2023-11-14T22:13+02", 1699992780), ("seen_at", "2023-02-29", None), ("seen_at", "2024-02-29", 1709164800), ("seen_at", "2023-13-01", None), ("seen_at", "2023-11-14T25:00:00Z", None), ("seen_at", "170000000", None), ("seen_at", "14/11/2023", None), ("seen_at", "1700000000s", None), ("seen_at", "yesterday", None),
    ("name", "  x y  ", "x y"), ("name", "none of these", "none of these"), ("name", "Null ", None), ("name", "?", None), ("name", "undefined", None), ("name", " \t　", None), ("name", "--", "--"),
]


def wide(spark, rows, spec=SPEC):
    df = spark.createDataFrame(rows, "snap_id bigint, db bigint, key binary, field binary, value binary").withColumns({c: F.lit("clash") for c in ("attr", "kind", "__attr", "unfit", "cast_failures", "age")})
    return widetable.wide_table(df, spec)


@pytest.mark.parametrize("kind", ["age", "score", "is_on", "seen_at", "name"])
def test_fit_values(spark, kind):
    cells = [(v, want) for a, v, want in CELLS if a == kind]
    rows = {bytes(r["key"]).decode(): r for r in wide(spark, [(1, 0, v.encode() + b"|%d" % i, kind.encode(), v.encode()) for i, (v, _) in enumerate(cells)]).collect()}
    for i, (v, want) in enumerate(cells):
        r = rows[f"{v}|{i}"]
        got = r[kind].replace(tzinfo=datetime.timezone.utc).timestamp() if kind == "seen_at" and r[kind] is not None else r[kind]
        assert got == (pytest.approx(want) if isinstance(want, float) else want), v
        assert r["cast_failures"] == ({} if want is not None else {kind: v.strip(widetable.BLANKS)})


def test_names_and_conflicts(spark):
    rows = [(1, 0, b"a", b"AGE", b"x"), (1, 0, b"a", b"A-g e", b"5"), (1, 0, b"a", b"age", b"7"), (1, 0, b"a", b"age2", b"9"), (1, 0, b"a", b"isOn", None), (1, 0, b"a", b"Db", b"3"), (1, 0, b"a", "ägé".encode(), b"8")]
    rows += [(1, 0, b"empty", None, None), (1, 0, b"stray", b"zzz", b"1"), (None, None, None, b"name", b"n"), (1, 0, b"bytes", b"name", b"\xff\xfe"), (1, 0, b"bytes", b"age", b"\xff1"), (1, 0, b"blank", b"", b"x")]
    df = wide(spark, rows * 3)
    assert df.columns == ["snap_id", "db", "key", "age", "score", "is_on", "seen_at", "name", "attr_db", "cast_failures"]
    got = {None if r["key"] is None else bytes(r["key"]): r for r in df.collect()}
    assert len(got) == 6 and df.count() == 6
    assert (got[b"a"]["age"], got[b"a"]["attr_db"], got[b"a"]["is_on"], got[b"a"]["cast_failures"]) == (5, 3, None, {})
    assert got[b"empty"]["cast_failures"] == {} and got[b"stray"]["age"] is None and got[None]["name"] == "n"
    assert got[b"bytes"]["name"] == "��" and got[b"bytes"]["cast_failures"] == {"age": "�1"}
    cells = {(bytes(r["key"]) if r["key"] is not None else None, r["attr"]) for r in widetable.filled_cells(df, SPEC).collect()}
    assert cells == {(b"a", "age"), (b"a", "db"), (None, "name"), (b"bytes", "name")}
    assert wide(spark, rows).limit(0).count() == 0 and wide(spark, []).collect() == []
    assert wide(spark, rows, []).columns == ["snap_id", "db", "key", "cast_failures"]


def test_spec(spark):
    spec = spark.createDataFrame([("b", "int"), ("a", "ts"), (None, "int"), ("a", "string")], "attr string, kind string")
    assert widetable.read_spec(spec) == [("a", "string"), ("b", "int")]
    for bad in ([("a", "money")], [("a", None)]):
        with pytest.raises(ValueError):
            widetable.read_spec(spark.createDataFrame(bad, "attr string, kind string"))
    with pytest.raises(ValueError):
        widetable.read_spec(spec, most=1)


# History


def brute_runs(rows, order):
    node_of = {s: (n, i) for n, snaps in order.items() for i, s in enumerate(snaps)}
    held = collections.defaultdict(set)
    for s, db, key, field, value, expiry in rows:
        if field is not None and s in node_of:
            n, i = node_of[s]
            held[(n, db, key, field, value, expiry)].add(i)
    out = set()
    for (n, *rest), at in held.items():
        for i in at:
            if i - 1 not in at:
                j = i
                while j in at:
                    j += 1
                out.add((n, *rest, order[n][i], order[n][j] if j < len(order[n]) else None))
    return out


@pytest.mark.parametrize("n_snaps", [1, 2, 9, 150])
def test_history(spark, n_snaps):
    files, order, last = files_of(spark, 2, n_snaps, n_snaps)
    rnd = random.Random(n_snaps)
    rows = []
    for s in range(1, last + 1):
        for k in range(4):
            if rnd.random() < 0.85:
                rows += [(s, rnd.choice([0, 0, 0, None]), b"k%d" % k, rnd.choice([b"f", b"f", None]), rnd.choice([b"v"] * 6 + [b"w", b"", None]), rnd.choice([None] * 5 + [7]))] * rnd.choice([1, 1, 2])
    rows += [(s, 0, b"hot", b"f", b"same", None) for s in range(1, last + 1) for _ in range(20)]
    df = spark.createDataFrame(rows, "snap_id bigint, db bigint, key binary, field binary, value binary, expiry_ms bigint").withColumn("start", F.lit("clash")).withColumn("node_id", F.lit(99))
    b = lambda v: None if v is None else bytes(v)
    got = [(r["node_id"], r["db"], b(r["key"]), b(r["field"]), b(r["value"]), r["expiry_ms"], r["from_snap_id"], r["until_snap_id"]) for r in history.version_runs(df, files).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(rows, order)
    assert history.version_runs(df.limit(0), files).collect() == [] and history.version_runs(df, files.limit(0)).collect() == []


# Snapshot differences


def brute_changes(rows, order):
    held = collections.defaultdict(lambda: collections.defaultdict(set))
    for s, db, key, value, expiry in rows:
        held[s][(db, key)].add((value, expiry))
    out = set()
    for n, snaps in order.items():
        for p, c in zip(snaps, snaps[1:]):
            for k in held[p].keys() | held[c].keys():
                kind = "added" if k not in held[p] else "removed" if k not in held[c] else "changed" if held[p][k] != held[c][k] else None
                if kind:
                    out.add((n, c, p, *k, kind))
    return out


def test_changes(spark, tmp_path):
    files, order, last = files_of(spark, 3, 8, 4)
    rnd = random.Random(4)
    long = b"x" * 50
    rows = [(s, rnd.choice([0, 0, 0, 1, None]), rnd.choice([b"k%d" % k, None]) if k < 2 else b"k%d" % k, rnd.choice([b"v"] * 8 + [b"w", b"", None, long, long + b"y"]), rnd.choice([None] * 8 + [5])) for s in range(1, last + 1) if s % 7 for k in range(200) if rnd.random() < 0.8]
    rows += rnd.sample(rows, 300) + [(1, 0, b"hot", b"v", None)] * 2000
    df = spark.createDataFrame(rows, "snap_id bigint, db bigint, key binary, value binary, expiry_ms bigint").withColumn("ordinal", F.lit("clash")).withColumn("node_id", F.lit(9))
    change = lambda **kw: [(r["node_id"], r["snap_id"], r["previous_snap_id"], r["db"], None if r["key"] is None else bytes(r["key"]), r["change_kind"]) for r in snapdiff.consecutive_changes(df, files, **kw)[0].collect()]
    got, want = change(), brute_changes(rows, order)
    assert len(got) == len(set(got)) and set(got) == want and {w[-1] for w in want} == {"added", "removed", "changed"}
    assert snapdiff.consecutive_changes(df.limit(0), files)[0].collect() == [] and snapdiff.consecutive_changes(df, files.limit(0))[0].collect() == []
    # A later run on the dictionary of one over some of the keys: those keep their ordinals.
    path = str(tmp_path / "ordinals")
    _, given = snapdiff.consecutive_changes(df.where("key < 'k3'"), files, dictionary=path)
    ordinals = lambda: {(r["node_id"], r["db"], None if r["key"] is None else bytes(r["key"])): r["ordinal"] for r in spark.read.parquet(path).collect()}
    first = ordinals()
    assert given == path and set(change(dictionary=path)) == want
    second = ordinals()
    assert first and len(second) > len(first) and first.items() <= second.items() and len(set(second.values())) == len(second)
    assert set(change(dictionary=path)) == want and ordinals() == second
    with pytest.raises(ValueError):
        snapdiff.consecutive_changes(df.withColumn("ordinal", F.lit(1)), files, ["db", "ordinal"], dictionary=path)
    with pytest.raises(ValueError):
        snapdiff.consecutive_changes(df, files, ["key"], dictionary=path)


def test_several_payloads_of_a_key(spark):
    """A hot key with very many payloads in a snapshot; sets of payloads are compared whole."""
    files = spark.createDataFrame([(s, 1, T0 + datetime.timedelta(days=s), True, "o", "s") for s in range(1, 5)], FILES)
    hot = spark.range(3000).select((F.col("id") % 4 + 1).alias("snap_id"), F.lit(0).cast("bigint").alias("db"), F.lit(b"hot").alias("key"), F.when(F.col("id") % 4 < 2, (F.col("id") / 4).cast("int")).otherwise((F.col("id") / 8).cast("int")).cast("string").cast("binary").alias("value"), F.lit(None).cast("bigint").alias("expiry_ms"))
    got = sorted((r["snap_id"], r["change_kind"]) for r in snapdiff.consecutive_changes(hot.unionByName(hot), files)[0].collect())
    assert got == [(3, "changed")]  # 1 and 2 hold the same 750 payloads, 3 and 4 the same half of them


def test_words_of_many_snapshots(spark):
    """A word whose keys all go, and one that comes back after a gap."""
    files = spark.createDataFrame([(s, 1, T0 + datetime.timedelta(days=s), True, "o", "s") for s in range(1, 8)], FILES)
    rows = [(s, 0, b"k%d" % k, b"v%d" % (s > 5), None) for k in range(130) for s in ((1, 2, 6, 7) if k < 64 else (3,) if k < 129 else range(1, 8))]
    df = spark.createDataFrame(rows, "snap_id bigint, db bigint, key binary, value binary, expiry_ms bigint")
    got = [(r["node_id"], r["snap_id"], r["previous_snap_id"], r["db"], bytes(r["key"]), r["change_kind"]) for r in snapdiff.consecutive_changes(df, files)[0].collect()]
    assert len(got) == len(set(got)) and set(got) == brute_changes(rows, {1: list(range(1, 8))})


# Weighted values


def test_skewed_lists(spark):
    rnd = random.Random(6)
    rows = [(1, 0, b"hot", i % 900, 900, rnd.choice([b"a", b"bb", b"ccc", None, b"d" * 300])) for i in range(3000)]
    rows += [(1, 0, b"lies", i, rnd.choice([3, 9]), b"x") for i in range(5)] + [(1, 0, b"empty", None, 0, None)] * 3 + [(None, None, None, 0, 1, b"")] + [(1, 0, b"unstated", 0, None, b"y"), (1, 0, b"tie", 0, 2, b"q"), (1, 0, b"tie", 1, 2, b"p")]
    df = spark.createDataFrame(rows, "snap_id bigint, db bigint, key binary, elem_index bigint, num_elements bigint, element binary").withColumn("value", F.lit("clash")).withColumn("weight", F.lit(5))
    k = lambda r: None if r["key"] is None else bytes(r["key"])
    got = {k(r): (r["n_rows"], r["true_length"], r["stated_length"]) for r in skewstats.list_lengths(df).collect()}
    assert got == {b"hot": (3000, 900, 900), b"lies": (5, 5, got[b"lies"][2]), b"empty": (3, 0, 0), None: (1, 1, 1), b"unstated": (1, 1, None), b"tie": (2, 2, 2)}
    key = ["snap_id", "db", "key"]
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r[5])
    modes = {k(r): (r["n_distinct"], None if r["mode"] is None else bytes(r["mode"]), r["mode_weight"]) for r in skewstats.modes(skewstats.weighted_values(df, key, "element", "value"), key).collect()}
    for name, vs in by.items():
        c = collections.Counter(v for v in vs if v is not None)
        top = min(c, key=lambda v: (-c[v], v)) if c else None
        assert modes[name] == (len(c), top, c.get(top))
    fractions = [0.0, 0.25, 0.5, 0.99, 1.0]
    sizes = skewstats.weighted_values(df, key, F.octet_length("element") * 70_001)
    got = {(k(r), r["fraction"]): r["value"] for r in skewstats.percentiles(sizes, key, fractions).collect()}
    want = {}
    for name, vs in by.items():
        ns = sorted(len(v) * 70_001 for v in vs if v is not None)
        for f in fractions if ns else []:
            want[(name, f)] = ns[max(1, -(-int(f * len(ns) * 1000) // 1000)) - 1] if f in (0.0, 1.0) else next(x for i, x in enumerate(ns, 1) if i >= f * len(ns))
    assert got == want
    empty = df.limit(0)
    assert skewstats.list_lengths(empty).collect() == [] and skewstats.percentiles(skewstats.weighted_values(empty, key, F.octet_length("element")), key, [0.5]).collect() == []


@pytest.mark.parametrize("numbers", [[-5, -1, 0, 3], [2**63 - 1, -(2**63), 0], [70_000, 70_001, 70_001, 5 << 40, 5 << 40], [-(5 << 40), -(5 << 40) + 3], [7], [-1, -1, 1 << 20, -(1 << 20)]])
def test_percentiles_of_any_whole_numbers(spark, numbers):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([*numbers, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, value bigint")
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["k"], r["fraction"]): r["value"] for r in skewstats.percentiles(skewstats.weighted_values(df, ["k"], "value"), ["k"], fractions).collect()}
    want = {}
    for k in ("a", "b", None):
        ns = sorted(v for x, v in rows if x == k and v is not None)
        want |= {(k, f): next(x for i, x in enumerate(ns, 1) if i >= f * len(ns)) for f in fractions}
    assert got == want


# Compaction


def tiny_files(folder, n, rows=lambda i: i % 4, **kw):
    os.makedirs(folder, exist_ok=True)
    for i in range(n):
        t = pa.table({"id": pa.array(range(i * 10, i * 10 + rows(i)), pa.int64()), "s": pa.array([None if j % 3 == 0 else f"text {j}" for j in range(rows(i))], pa.string()), "l": pa.array([[j] * (j % 3) for j in range(rows(i))], pa.list_(pa.float64()))})
        pq.write_table(t, f"{folder}/f{i:04d}.parquet", **kw)


local = lambda r: r["out_path"].removeprefix("file:").removeprefix("//")


def test_blocks_are_copied(spark, tmp_path):
    """With small_bytes 0 every row group is copied as it is."""
    folder = str(tmp_path / "in")
    tiny_files(folder, 60, compression="snappy")
    tiny_files(f"{folder}/more", 5, lambda i: 900, compression="zstd", row_group_size=100, use_dictionary=False, write_page_index=True, write_statistics=True)
    before = sorted(spark.read.option("recursiveFileLookup", "true").parquet(folder).collect(), key=repr)
    out, report = compaction.compact_files(spark, folder, target_bytes=40_000, small_bytes=0)
    got = report.collect()
    assert sum(r["n_files"] for r in got) == 65 and sum(r["n_rows"] for r in got) == len(before) and 1 < len(got) < 65
    blocks = sum(pq.ParquetFile(f).num_row_groups for f in (tmp_path / "in").rglob("*.parquet"))
    assert sum(r["n_blocks"] for r in got) == sum(r["n_groups"] for r in got) == blocks
    assert sorted(spark.read.parquet(out).collect(), key=repr) == before
    assert sum(pq.read_table(local(r)).num_rows for r in got) == len(before)
    assert spark.read.parquet(out).where("id = 21").count() == spark.read.option("recursiveFileLookup", "true").parquet(folder).where("id = 21").count()
    # statistics still serve filters
    meta = pq.ParquetFile(local(got[0])).metadata
    assert all(meta.row_group(i).column(0).is_stats_set for i in range(meta.num_row_groups) if meta.row_group(i).num_rows)


KINDS = {"i": pa.int32(), "u": pa.uint64(), "f": pa.float32(), "d": pa.float64(), "b": pa.bool_(), "s": pa.string(), "y": pa.binary(), "x": pa.binary(5), "t": pa.timestamp("us"), "m": pa.decimal128(20, 3), "l": pa.list_(pa.string()), "n": pa.struct([("a", pa.int64()), ("l", pa.list_(pa.list_(pa.bool_())))])}


def any_value(rnd, kind):
    return {"i": lambda: rnd.choice([-5, 7, 2**31 - 1]), "u": lambda: rnd.choice([0, 2**64 - 1, 9]), "f": lambda: rnd.choice([0.5, -1.25]), "d": lambda: rnd.choice([1e300, -2.5, 0.0]), "b": lambda: rnd.random() < 0.5, "s": lambda: rnd.choice(["", "é", "text", "z" * 300, str(rnd.random())]), "y": lambda: rnd.choice([b"", b"\xff", rnd.randbytes(9)]),
            "x": lambda: rnd.randbytes(5), "t": lambda: T0 + datetime.timedelta(seconds=rnd.randint(0, 9)), "m": lambda: decimal.Decimal(rnd.randint(-99, 99)) / 8, "l": lambda: [rnd.choice([None, "p", "q"]) for _ in range(rnd.randint(0, 3))], "n": lambda: {"a": rnd.choice([None, 3]), "l": rnd.choice([None, [], [[True, None], []], [None]])}}[kind]()


WRITERS = [dict(), dict(compression="zstd", data_page_version="2.0"), dict(compression="none", use_dictionary=False), dict(compression="gzip", use_dictionary=["s", "i"]), dict(compression="snappy", use_dictionary=False, column_encoding={"i": "DELTA_BINARY_PACKED", "s": "DELTA_BYTE_ARRAY", "d": "BYTE_STREAM_SPLIT"}), dict(compression="lz4", data_page_size=100, write_batch_size=7)]


@pytest.mark.parametrize("n_writer", range(len(WRITERS)))
@pytest.mark.parametrize("page", [20_000, 50])
def test_small_groups_are_merged(tmp_path, monkeypatch, n_writer, page):
    """Every type, level and encoding; the tables are the same, in order, and statistics hold."""
    monkeypatch.setattr(parquetpages, "PAGE_VALUES", page)
    if page == 50:
        monkeypatch.setattr(parquetpages, "DICTIONARY_BYTES", 400)
    rnd, paths, tables = random.Random(n_writer), [], []
    for i in range(40):
        n = rnd.choice([0, 1, 2, 5, 9, 60])
        absent = rnd.choice([0, 0.3, 1])
        t = pa.table({k: pa.array([None if rnd.random() < absent else any_value(rnd, k) for _ in range(n)], t) for k, t in KINDS.items()})
        paths.append(str(tmp_path / f"{i:03d}.parquet"))
        pq.write_table(t, paths[-1], **WRITERS[n_writer])
        tables.append(t)
    want = pa.concat_tables(tables)
    out = str(tmp_path / "out.parquet")
    blocks, groups, rows, size = parquetblocks.join_files(paths, out)
    f = pq.ParquetFile(out)
    assert (blocks, groups, rows, size) == (sum(pq.ParquetFile(p).num_row_groups for p in paths), 1, want.num_rows, os.path.getsize(out)) and f.num_row_groups == 1
    assert f.read().equals(want)
    meta = f.metadata.row_group(0)
    for k, c in (("i", 0), ("u", 1), ("s", 5)):
        s, vs = meta.column(c).statistics, [v for v in want[k].to_pylist() if v is not None]
        assert s.null_count == want[k].null_count and (not s.has_min_max or (s.min, s.max) == (min(vs, key=lambda v: v.encode() if k == "s" else v), max(vs, key=lambda v: v.encode() if k == "s" else v)))
    again = str(tmp_path / "again.parquet")
    assert parquetblocks.join_files([out, *paths[:3]], again)[2] == want.num_rows + sum(t.num_rows for t in tables[:3])
    assert pq.read_table(again).equals(pa.concat_tables([want, *tables[:3]]))


def test_mixed_sizes_and_codecs(spark, tmp_path):
    """Large groups are copied, small ones of one codec merged."""
    folder = str(tmp_path / "in")
    tiny_files(folder, 40, lambda i: 3, compression="snappy")
    tiny_files(f"{folder}/b", 1, lambda i: 5000, compression="snappy")
    tiny_files(f"{folder}/c", 2, lambda i: 4, compression="zstd")
    out, report = compaction.compact_files(spark, folder, small_bytes=10_000)
    (r,) = report.collect()
    assert (r["n_files"], r["n_blocks"], r["n_groups"], r["n_rows"]) == (43, 43, 3, 40 * 3 + 5000 + 8)
    assert sorted(spark.read.parquet(out).collect(), key=repr) == sorted(spark.read.option("recursiveFileLookup", "true").parquet(folder).collect(), key=repr)


def test_rounds(spark, tmp_path):
    """More files than one task joins, and files without rows."""
    folder = str(tmp_path / "in")
    tiny_files(folder, 50, lambda i: i % 3)
    pq.write_table(pa.table({"other": pa.array([1])}), f"{folder}/other.parquet")
    out, report = compaction.compact_files(spark, folder, files_per_bin=4)
    assert sorted((r["n_files"], r["n_rows"], r["n_groups"]) for r in report.collect()) == [(1, 1, 1), (50, sum(i % 3 for i in range(50)), 1)]
    assert spark.read.option("mergeSchema", "true").parquet(out).where("id is not null").count() == sum(i % 3 for i in range(50))


def test_schemas_stay_apart(spark, tmp_path):
    folder = str(tmp_path / "in")
    tiny_files(folder, 6)
    for i in range(4):
        pq.write_table(pa.table({"id": pa.array([str(i)])}), f"{folder}/other{i}.parquet")
    _, report = compaction.compact_files(spark, folder)
    assert sorted((r["n_files"], r["n_rows"]) for r in report.collect()) == [(4, 4), (6, 7)]
    with pytest.raises(parquetblocks.IncompatibleBlocks):
        parquetblocks.join_files([f"{folder}/f0001.parquet", f"{folder}/other0.parquet"], str(tmp_path / "x.parquet"))


def test_unsound_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.parquet").write_bytes(b"PAR1 not a file PAR1")
    with pytest.raises(Exception, match="a.parquet"):
        compaction.compact_files(spark, str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    out, report = compaction.compact_files(spark, str(tmp_path / "none"))
    assert report.collect() == []


def test_entries_once(spark):
    rows = [("5-0", b"a", b"1", 1), ("5-0", b"b", b"2", 1), ("5", b"a", b"1", 2), ("05-00", b"a", b"1", 3), ("6-1", b"a", b"1", 1), ("6-1", b"a", b"1", 1), ("6-1", b"a", b"1", 2), ("7-1", b"f", None, 1), ("7-1", b"f", None, 1), (None, None, None, 1), (None, None, None, 2), ("odd", b"x", b"y", 1), ("odd", b"x", b"y", 2), ("8-", b"x", b"y", 1), ("9-1", b"x", b"y", None), ("9-1", b"x", b"y", 1), ("18446744073709551615-18446744073709551615", b"x", b"y", 1), ("18446744073709551615-18446744073709551615", b"x", b"y", 2)]
    df = spark.createDataFrame([(1, 0, b"k", *r, "clash", "clash") for r in rows] + [(None, None, None, *rows[0], "c", "c"), (None, None, None, *rows[2], "c", "c")], "snap_id bigint, db bigint, key binary, stream_id string, field binary, field_value binary, file_id bigint, __ms string, n_rows string")
    top = 2**64 - 1
    b = lambda v: None if v is None else bytes(v)
    held = {(b(r["key"]), int(r["id_ms"]), int(r["id_seq"])) for r in compaction.held_by_several(df).collect()}
    assert held == {(b"k", 5, 0), (b"k", 6, 1), (None, 5, 0), (b"k", top, top)}
    once = collections.Counter((b(r["key"]), r["id_ms"] and int(r["id_ms"]), b(r["field"]), b(r["field_value"])) for r in compaction.exactly_once(df).collect())
    assert once == {(b"k", 5, b"a", b"1"): 1, (b"k", 5, b"b", b"2"): 1, (b"k", 6, b"a", b"1"): 2, (b"k", 7, b"f", None): 2, (b"k", None, None, None): 1, (b"k", None, b"x", b"y"): 1, (b"k", 8, b"x", b"y"): 1, (b"k", 9, b"x", b"y"): 1, (b"k", top, b"x", b"y"): 1, (None, 5, b"a", b"1"): 1}
    assert compaction.held_by_several(df.limit(0)).collect() == [] and compaction.exactly_once(df.limit(0)).collect() == []


def test_shared_folder(spark):
    assert shared_dir(spark).startswith("file:/") and shared_dir(spark) == shared_dir(spark)

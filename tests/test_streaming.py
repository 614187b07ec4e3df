"""Snapshots that arrive in a folder."""

from pyspark.sql import functions as F

from keyquarry.codec import names as N
from keyquarry.streaming import snapshots
from testkit import encoder as E


def drop(folder, name, keys, expiry=None):
    s = E.Snapshot()
    for k in keys:
        s.add(N.STRING, k, E.string(b"v"), expiry_ms=expiry)
    (folder / name).write_bytes(s.bytes())


def test_follow(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    drop(source, "a.rdb", [b"a1", b"a2"])
    (source / "ignored.txt").write_text("x")

    def run():
        q = snapshots.follow(spark, str(source), str(out), str(state), {"string"}, once=True, files_per_batch=1)
        q.awaitTermination()

    run()
    drop(source, "b.rdb", [b"b1"], expiry=5000)
    drop(source, "c.rdb", [b"c1"])
    run()
    run()
    rows = spark.read.parquet(str(out / "string.parquet"))
    assert {bytes(r["key"]) for r in rows.collect()} == {b"a1", b"a2", b"b1", b"c1"} and rows.count() == 4
    assert rows.select("batch").distinct().count() == 3
    assert [bytes(r["key"]) for r in snapshots.expiring(rows, 1000, 4500).collect()] == [b"b1"] and snapshots.expiring(rows, 0, 4000).count() == 0
    assert rows.where(F.col("type") != "string").count() == 0

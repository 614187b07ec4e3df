"""The test tables as snapshots: one keyspace per table and encoding, written in parallel, one file per task."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyquarry.codec import names as N
from keyquarry.runtime import fresh_path, ship
from keyquarry.sources.parquetblocks import open_fs

from . import encoder as E

FAR = 4102444800000
FILES = 4


@dataclass(frozen=True)
class Keyspace:
    """How a table becomes keys: grouped rows (one per key, columns __key and whatever encode needs) and their bytes.

    code may depend on the row; before gives what stands before an entry beside its db and expiry.
    """

    rows: Callable[[SparkSession, str], DataFrame]
    code: int | Callable[[dict], int]
    encode: Callable[[dict], bytes]
    db: Callable[[dict], int] = lambda r: 0
    expiry: Callable[[dict], int | None] = lambda r: None
    magic: str = "VALKEY"
    before: Callable[[dict], bytes] = lambda r: b""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string")).alias("__key")


def _nation(spark, d):
    return _table(spark, d, "nation").select(_key("nation:", "n_nationkey"), "n_name", "n_regionkey")


def _nations(spark, d):
    return _table(spark, d, "nation").select(_key("nation:", "n_nationkey"), "n_name", F.col("n_nationkey").cast("int").alias("n_nationkey"))


def _customer(spark, d):
    return _table(spark, d, "customer").select(_key("customer:", "c_custkey"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey")


def _orders(spark, d):
    return _table(spark, d, "orders").groupBy(_key("orders:", "o_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("items"))


def _brands(spark, d):
    return _table(spark, d, "part").groupBy(_key("brand:", "p_brand")).agg(F.sort_array(F.collect_list("p_partkey")).alias("items"))


def _totals(spark, d):
    return _table(spark, d, "orders").groupBy(_key("totals:", "o_orderpriority")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("items"))


def _geo(spark, d):
    score = F.expr("cast(cast(c_custkey as decimal(38,0)) * 299999999977 % 4503599627370496 as double)")
    return _table(spark, d, "customer").groupBy(_key("geo:", "c_nationkey")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", score.alias("score")))).alias("items"))


def _hll(spark, d):
    return _table(spark, d, "documents").groupBy(F.concat(F.lit("hll:"), F.coalesce("lang", F.lit(""))).alias("__key")).agg(F.count_distinct("source").alias("n"))


def _parts(spark, d):
    return _table(spark, d, "part").select(_key("mod:", "p_partkey"), "p_size", "p_retailprice", "p_name")


def _events(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _table(spark, d, "events").groupBy(_key("user:", "user_id")).agg(F.sort_array(F.collect_list(F.struct(ms.alias("ms"), "event_id", "event_type"))).alias("items"))


def _suppliers(spark, d):
    return _table(spark, d, "supplier").select(_key("supplier:", "s_suppkey"), "s_name", "s_nationkey")


def _documents(spark, d):
    return _table(spark, d, "documents").where(F.col("text").isNotNull()).select(_key("doc:", "doc_id"), "text")


def _int_strings(items) -> list[bytes]:
    return [b"%d" % i for i in items]


def _hash_pairs(r) -> list[tuple[bytes, bytes]]:
    return [(b"name", r["c_name"].encode()), (b"segment", r["c_mktsegment"].encode()), (b"nation", b"%d" % r["c_nationkey"])]


def _flat(pairs) -> list[bytes]:
    return [x for p in pairs for x in p]


def _scored(r) -> list[tuple[bytes, float]]:
    return [(b"%d" % x[0], float(x[1])) for x in r["items"]]


def _log(r) -> list[tuple[int, int, list[tuple[bytes, bytes]]]]:
    out, last, seq = [], None, 0
    for ms, event, kind in r["items"]:
        seq = seq + 1 if ms == last else 0
        last = ms
        out.append((ms, seq, [(b"type", kind.encode()), (b"event", b"%d" % event)]))
    return out


def _expiring(r) -> int | None:
    return FAR + r["c_custkey"] if r["c_custkey"] % 2 == 0 else None


def _plain_hash(r) -> bytes:
    pairs = _hash_pairs(r)
    return E.length(len(pairs)) + b"".join(E.string(f) + E.string(v) for f, v in pairs)


def _hash2(r) -> bytes:
    rows = [(b"name", r["s_name"].encode(), -1), (b"nation", b"%d" % r["s_nationkey"], FAR)]
    return E.length(2) + b"".join(E.string(f) + E.string(v) + struct.pack("<q", t) for f, v, t in rows)


def _zset2(pairs) -> bytes:
    return E.length(len(pairs)) + b"".join(E.string(m) + struct.pack("<d", s) for m, s in pairs)


def _hll_value(r) -> bytes:
    return E.string(b"HYLL\x01\x00\x00\x00" + struct.pack("<Q", r["n"]) + b"\x00\x00")


def _evictions(r) -> bytes:
    """Idle times, frequencies, and expiries in seconds."""
    n = r["n_nationkey"]
    kind = bytes([N.OP_IDLE]) + E.length(n * 1000) if n % 2 else bytes([N.OP_FREQ, n * 10])
    return kind + (bytes([N.OP_EXPIRETIME]) + struct.pack("<i", 2_000_000_000 + n) if n % 3 == 0 else b"")


def _passed_over(r) -> bytes:
    """What stands between entries and belongs to none."""
    module = E.module("testparts", 1, [("sint", 7), ("float", 0.5), ("double", 2.5), ("string", b"aside")])
    identity = len(E.length(E.module_id("testparts", 1)))
    return [
        bytes([N.OP_RESIZEDB]) + E.length(70_000) + E.length(3), bytes([N.OP_FUNCTION2]) + E.string(b"function code"),
        bytes([N.OP_MODULE_AUX]) + E.length(E.module_id("testparts", 1)) + E.length(2) + E.length(1) + module[identity:],
        bytes([N.OP_SLOT_INFO]) + E.length(5) + E.length(6) + E.length(7), bytes([N.OP_SLOT_IMPORT]) + E.string(b"job") + E.length(2) + E.length(1) + E.length(9) + E.length(11) + E.length(12),
    ][r["n_nationkey"] % 5]


#: Empty values of each collection, in order of codes' names.
EMPTIES = ((N.LIST, E.length(0)), (N.SET, E.length(0)), (N.ZSET_2, E.length(0)), (N.HASH, E.length(0)), (N.STREAM_3, E.stream([])), (N.MODULE_2, E.module("testparts", 4, [])), (N.STRING, E.string(b"")))


def _dense(r) -> bytes:
    """A dense sketch, whose count is marked stale where it is odd."""
    return E.string(b"HYLL\x00\x00\x00\x00" + struct.pack("<Q", r["n"] | (r["n"] % 2) << 63) + bytes(12288))


KEYSPACES: dict[str, Keyspace] = {
    "strings": Keyspace(_nation, N.STRING, lambda r: E.string(r["n_name"].encode()), db=lambda r: r["n_regionkey"]),
    "hash": Keyspace(_customer, N.HASH_LISTPACK, lambda r: E.string(E.listpack(_flat(_hash_pairs(r)))), expiry=_expiring),
    "hash_ziplist": Keyspace(_customer, N.HASH_ZIPLIST, lambda r: E.string(E.ziplist(_flat(_hash_pairs(r)))), expiry=_expiring, magic="REDIS"),
    "hash_plain": Keyspace(_customer, N.HASH, _plain_hash, expiry=_expiring),
    "list": Keyspace(_orders, N.LIST_QUICKLIST_2, lambda r: E.quicklist2(_int_strings(r["items"]), 8)),
    "list_quicklist1": Keyspace(_orders, N.LIST_QUICKLIST, lambda r: E.quicklist1(_int_strings(r["items"]), 8), magic="REDIS"),
    "list_ziplist": Keyspace(_orders, N.LIST_ZIPLIST, lambda r: E.string(E.ziplist(_int_strings(r["items"]))), magic="REDIS"),
    "list_plain": Keyspace(_orders, N.LIST, lambda r: E.plain_strings(_int_strings(r["items"]))),
    "set": Keyspace(_brands, N.SET_INTSET, lambda r: E.string(E.intset(r["items"]))),
    "set_listpack": Keyspace(_brands, N.SET_LISTPACK, lambda r: E.string(E.listpack(_int_strings(r["items"])))),
    "set_plain": Keyspace(_brands, N.SET, lambda r: E.length(len(r["items"])) + b"".join(E.int_string(i) for i in r["items"])),
    "zset": Keyspace(_totals, N.ZSET_2, lambda r: _zset2(_scored(r))),
    "zset_listpack": Keyspace(_totals, N.ZSET_LISTPACK, lambda r: E.string(E.listpack([x for m, s in _scored(r) for x in (m, E.score_text(s))]))),
    "zset_ziplist": Keyspace(_totals, N.ZSET_ZIPLIST, lambda r: E.string(E.ziplist([x for m, s in _scored(r) for x in (m, E.score_text(s))])), magic="REDIS"),
    "zset_v1": Keyspace(_totals, N.ZSET, lambda r: E.length(len(r["items"])) + b"".join(E.string(m) + E.text_score(s) for m, s in _scored(r))),
    "geo": Keyspace(_geo, N.ZSET_2, lambda r: _zset2(_scored(r))),
    "hll": Keyspace(_hll, N.STRING, _hll_value),
    "module": Keyspace(_parts, N.MODULE_2, lambda r: E.module("testparts", 3, [("uint", r["p_size"]), ("double", r["p_retailprice"]), ("string", r["p_name"].encode())])),
    "stream": Keyspace(_events, N.STREAM_3, lambda r: E.stream(_log(r), N.STREAM_3, groups=E.consumer_groups(N.STREAM_3))),
    "stream_v2": Keyspace(_events, N.STREAM_2, lambda r: E.stream(_log(r), N.STREAM_2, groups=E.consumer_groups(N.STREAM_2))),
    "stream_v1": Keyspace(_events, N.STREAM_1, lambda r: E.stream(_log(r), N.STREAM_1, groups=E.consumer_groups(N.STREAM_1)), magic="REDIS"),
    "hash2": Keyspace(_suppliers, N.HASH_2, _hash2),
    "evictions": Keyspace(_nations, N.STRING, lambda r: E.string(r["n_name"].encode()), before=_evictions),
    "passed_over": Keyspace(_nations, N.STRING, lambda r: E.string(r["n_name"].encode()), before=_passed_over),
    "zipmaps": Keyspace(_nations, lambda r: N.HASH_ZIPMAP if r["n_nationkey"] % 5 == 0 else N.STRING, lambda r: E.string(r["n_name"].encode())),
    "empties": Keyspace(_nations, lambda r: EMPTIES[r["n_nationkey"] % 7][0], lambda r: EMPTIES[r["n_nationkey"] % 7][1]),
    "dense": Keyspace(_hll, N.STRING, _dense),
    "module_kinds": Keyspace(_parts, N.MODULE_2, lambda r: E.module("testkinds", 1000, [("sint", r["p_size"]), ("float", r["p_size"] / 4)])),
    "lzf": Keyspace(_documents, N.STRING, lambda r: E.lzf_string(r["text"].encode()) if r["text"] else E.string(b"")),
}

_built: dict[tuple[str, str, str], str] = {}


def build(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder with a keyspace's snapshot files, built once per application and tables."""
    ship(spark)
    known = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if known in _built:
        return _built[known]
    space = KEYSPACES[name]
    folder = fresh_path(spark, f"keyspace-{name}")
    rows = space.rows(spark, sf_dir)
    columns = rows.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        snapshot = E.Snapshot(space.magic, 80 if space.magic == "VALKEY" else 11)
        n = 0
        for pdf in batches:
            for values in pdf.itertuples(index=False, name=None):
                r = dict(zip(columns, values))
                if "items" in r:  # numbers and structs of an array, as plain Python
                    r["items"] = [tuple(x.values()) if isinstance(x, dict) else x for x in getattr(r["items"], "tolist", lambda items=r["items"]: items)()]
                snapshot.select(space.db(r)).raw(space.before(r))
                snapshot.add(space.code(r) if callable(space.code) else space.code, r["__key"].encode(), space.encode(r), space.db(r), space.expiry(r))
                n += 1
        filesystem, target = open_fs(folder)
        filesystem.create_dir(target, recursive=True)
        with filesystem.open_output_stream(f"{target}/part-{TaskContext.get().partitionId():05d}.rdb") as f:
            f.write(snapshot.bytes())
        yield pd.DataFrame({"n": [n]})

    rows.repartition(FILES, F.xxhash64("__key")).mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    _built[known] = folder
    return folder

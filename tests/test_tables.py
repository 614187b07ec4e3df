"""From snapshot files to tables, summaries, filters, exports and validation."""

import json
import math
import os
import struct
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keyquarry import api, cli
from keyquarry.codec import names as N
from keyquarry.functions import columns as C
from keyquarry.functions import schemas
from keyquarry.operators import summary
from keyquarry.operators.tables import find_parts, read_entries, read_info, read_parts, select_entries, table, tables
from keyquarry.sources import sinks
from testkit import encoder as E

FAR = 4102444800000
LOG = [(1690001112223, 0, [(b"valve", b"north"), (b"turns", b"17")]), (1690001112230, 4, [(b"valve", b"south"), (b"turns", b"-8")]), (1690001112299, 0, [])]
#: Positions, made by interleaving 26-bit cells, and where they are.
PLACES = {b"lisbon": (-9.139, 38.722), b"quito": (-78.467, -0.180)}


def position(lon, lat):
    """The 52-bit score of a position: bits of the longitude's cell and the latitude's cell in turn."""
    x, y = int((lon + 180) / 360 * 2**26), int((lat + 85.05112878) / 170.10225756 * 2**26)
    return float(sum((x >> i & 1) << 2 * i + 1 | (y >> i & 1) << 2 * i for i in range(26)))


LISBON, QUITO = (position(*p) for p in PLACES.values())


def hash_body(pairs):
    return E.string(E.listpack([x for p in pairs for x in p]))


def zset_body(pairs):
    return E.length(len(pairs)) + b"".join(E.string(m) + struct.pack("<d", s) for m, s in pairs)


def basic(magic="VALKEY", version=80):
    s = E.Snapshot(magic, version)
    s.add(N.STRING, b"tide_note", E.string(b"seven tides"))
    s.add(N.LIST_QUICKLIST_2, b"tide_list", E.quicklist2([b"red", b"", b"blue"]))
    s.add(N.SET_LISTPACK, b"tide_set", E.string(E.listpack([b"oak", b"elm", b"ash"])))
    s.add(N.ZSET_LISTPACK, b"tide_zset", E.string(E.listpack([b"pump", b"4.25", b"sluice", b"-7.5", b"weir", b"19.75"])))
    s.add(N.HASH_LISTPACK, b"tide_hash", hash_body([(b"depth", b"12"), (b"bed", b"gravel"), (b"gate", b"shut")]))
    s.add(N.STRING, b"ebb", E.string(b"low water"), expiry_ms=FAR)
    return s


def mixed():
    """Every type, empty collections, virtual types, several dbs."""
    s = basic()
    s.add(N.LIST, b"empty_list", E.length(0), db=1).add(N.SET, b"empty_set", E.length(0), db=1).add(N.ZSET_2, b"empty_zset", E.length(0), db=1).add(N.HASH, b"empty_hash", E.length(0), db=1)
    s.add(N.ZSET_2, b"places", zset_body([(b"lisbon", LISBON), (b"quito", QUITO)]), db=2, idle=2**63, freq=255)
    s.add(N.ZSET_2, b"odd_scores", zset_body([(b"nan", math.nan), (b"inf", math.inf)]), db=2)
    s.add(N.ZSET_LISTPACK, b"small_ints", E.string(E.listpack([b"a", 1, b"b", 2])), db=2)
    s.add(N.STRING, b"sketch", E.string(b"HYLL\x00\x00\x00\x00" + struct.pack("<Q", 77) + b"\x00" * 4), db=2)
    s.add(N.STRING, b"stale", E.string(b"HYLL\x01\x00\x00\x00" + b"\x05" + b"\x00" * 6 + b"\x80"), db=2)
    s.add(N.STRING, b"no_sketch", E.string(b"HYLL\x02\x00\x00\x00" + b"\x00" * 8), db=2)
    s.add(N.STRING, b"short_sketch", E.string(b"HYLL\x01" + b"\x00" * 10), db=2)
    s.add(N.MODULE_2, b"mod", E.module("testparts", 5, [("sint", 2**64 - 1), ("uint", 5), ("float", 0.5), ("double", 2.5), ("string", b"s")]), db=2)
    s.add(N.MODULE_2, b"empty_mod", E.module("testparts", 5, []), db=2)
    s.add(N.STREAM_3, b"log", E.stream(LOG, groups=E.consumer_groups(N.STREAM_3)), db=3)
    s.add(N.STREAM_1, b"empty_log", E.stream([], N.STREAM_1), db=3)
    s.add(N.HASH_2, b"hfe", E.length(2) + E.string(b"stay") + E.string(b"1") + struct.pack("<q", -1) + E.string(b"go") + E.string(b"2") + struct.pack("<q", FAR), db=3)
    s.add(N.HASH_ZIPMAP, b"old", E.string(b"blob"), db=3, expiry_ms=1)
    s.add(N.STRING, b"\xff\xfe", E.string(b""), db=3, expiry_ms=1000000000000)
    return s


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dumps")
    out = {}
    big = E.Snapshot().add(N.LIST, b"big", E.plain_strings([b"%d" % i for i in range(500)])).add(N.ZSET_2, b"bigz", zset_body([(b"%d" % i, float(i)) for i in range(200)])).add(N.HASH_LISTPACK, b"h", hash_body([(b"a", b"1"), (b"b", b"2")]))
    for name, s in (("basic", basic()), ("compat", basic("REDIS", 9)), ("mixed", mixed()), ("big", big), ("empty", E.Snapshot())):
        (folder / f"{name}.rdb").write_bytes(s.bytes())
        out[name] = str(folder / f"{name}.rdb")
    (folder / "broken").mkdir()
    (folder / "broken/crc.rdb").write_bytes(basic().bytes(crc=5))
    (folder / "broken/short.rdb").write_bytes(basic().bytes()[:-30])
    (folder / "broken/magic.rdb").write_bytes(b"NOTADUMP1 and more")
    return out | {"folder": str(folder)}


def rows(df, *names):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*(names or df.columns)).collect()]


def kind(spark, files, name, which="mixed", **options):
    df = table(read_entries(spark, files[which], **options), name, order=True)
    return df.orderBy("seq", *(["index"] if name == "list" else []))


def test_schemas(spark, files):
    for name, df in tables(read_entries(spark, files["mixed"])).items():
        assert df.columns == [f.name for f in schemas.schema_for(name)]
        assert [f.dataType for f in df.schema] == [f.dataType for f in schemas.schema_for(name)]
    assert {n: len(schemas.schema_for(n)) for n in schemas.TYPES} == {"string": 9, "list": 10, "set": 9, "zset": 10, "hash": 11, "geo": 12, "hyperloglog": 11, "module": 15, "stream": 11}


@pytest.mark.parametrize("which", ["basic", "compat"])
def test_basic(spark, files, which):
    assert rows(kind(spark, files, "string", which), "key", "value", "expiry_ms", "encoding", "num_elements") == [(b"tide_note", b"seven tides", None, "string", 1), (b"ebb", b"low water", FAR, "string", 1)]
    assert rows(kind(spark, files, "list", which), "index", "element", "encoding") == [(0, b"red", "quicklist2"), (1, b"", "quicklist2"), (2, b"blue", "quicklist2")]
    assert rows(kind(spark, files, "zset", which), "member", "score") == [(b"pump", 4.25), (b"sluice", -7.5), (b"weir", 19.75)]
    assert kind(spark, files, "geo", which).count() == 0 and kind(spark, files, "hyperloglog", which).count() == 0
    info = api.inspect(spark, files[which])
    assert info["magic"] == {"basic": "VALKEY", "compat": "REDIS"}[which] and info["rdb_version"] == {"basic": 80, "compat": 9}[which] and info["server_version"] == "8.0.1"
    assert info["total_keys"] == 6 and info["dbs"] == [{"db": 0, "keys": 6, "types": {"string": 2, "list": 1, "set": 1, "zset": 1, "hash": 1}}]


def test_empty_snapshot(spark, files):
    assert read_entries(spark, files["empty"]).count() == 0 and api.read(spark, files["empty"]) == {}
    assert api.inspect(spark, files["empty"])["total_keys"] == 0
    assert rows(read_info(spark, files["empty"]), "crc_checked", "skipped_unknown") == [(True, 0)]


def test_empty_collections_have_a_row(spark, files):
    for name, key, own in (("list", b"empty_list", ("index", "element")), ("set", b"empty_set", ("member",)), ("zset", b"empty_zset", ("member", "score")), ("hash", b"empty_hash", ("field", "field_value", "field_expiry_ms")), ("stream", b"empty_log", ("stream_id", "field", "field_value"))):
        assert rows(kind(spark, files, name).where(F.col("key") == key), "num_elements", *own) == [(0, *[None] * len(own))]
    assert rows(kind(spark, files, "module").where(F.col("key") == b"empty_mod"), "num_elements", "value_index", "opcode", "int_value") == [(0, 0, "eof", None)]


def test_virtual_types(spark, files):
    got = rows(kind(spark, files, "geo"), "key", "type", "member", "longitude", "latitude", "geohash_score", "lru_idle_secs", "lfu_frequency")
    assert [(g[0], g[1], g[2]) for g in got] == [(b"places", "geo", b"lisbon"), (b"places", "geo", b"quito"), (b"small_ints", "geo", b"a"), (b"small_ints", "geo", b"b")]
    assert got[0][3:5] == pytest.approx(PLACES[b"lisbon"], abs=1e-4) and got[1][3:5] == pytest.approx(PLACES[b"quito"], abs=1e-4)
    assert got[0][5:] == (LISBON, Decimal(2**63), 255)
    assert {r[0] for r in rows(kind(spark, files, "zset"), "key")} >= {b"places", b"small_ints", b"odd_scores"}
    assert table(read_entries(spark, files["mixed"]), "geo", frozenset()).count() == 0
    assert rows(kind(spark, files, "hyperloglog"), "key", "type", "hll_encoding", "cached_cardinality", "num_elements") == [(b"sketch", "hyperloglog", "dense", 77, 1), (b"stale", "hyperloglog", "sparse", -1, 1)]
    assert {b"no_sketch", b"short_sketch"} <= {r[0] for r in rows(kind(spark, files, "string"), "key")}


def test_modules_streams_field_expiry(spark, files):
    got = rows(kind(spark, files, "module").where("num_elements > 0"), "module_name", "module_version", "value_index", "opcode", "int_value", "double_value", "string_value")
    assert got == [("testparts", 5, 0, "sint", Decimal(2**64 - 1), None, None), ("testparts", 5, 1, "uint", Decimal(5), None, None), ("testparts", 5, 2, "float", None, 0.5, None), ("testparts", 5, 3, "double", None, 2.5, None), ("testparts", 5, 4, "string", None, None, b"s")]
    got = rows(kind(spark, files, "stream").where(F.col("key") == b"log"), "stream_id", "field", "field_value", "num_elements")
    assert got == [("1690001112223-0", b"valve", b"north", 3), ("1690001112223-0", b"turns", b"17", 3), ("1690001112230-4", b"valve", b"south", 3), ("1690001112230-4", b"turns", b"-8", 3), ("1690001112299-0", None, None, 3)]
    assert rows(kind(spark, files, "hash").where(F.col("key") == b"hfe"), "field", "field_value", "field_expiry_ms") == [(b"stay", b"1", None), (b"go", b"2", FAR)]
    assert rows(read_info(spark, files["mixed"]), "skipped_unknown") == [(1,)]


def test_geo_positions(spark):
    scores = [-1.0, 1.5, 2.0**52, math.nan, math.inf, -math.inf, 0.0, -0.0, 2.0**52 - 1]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r[0] for r in df.select(C.valid_geohash(F.col("s"))).collect()] == [False] * 6 + [True] * 3
    lon, lat = df.where("s = 0").select(C.geohash_longitude(F.col("s")), C.geohash_latitude(F.col("s"))).first()
    assert lon == pytest.approx(-180, abs=1e-4) and lat == pytest.approx(-85.05112878, abs=1e-4)


@pytest.mark.parametrize("n", [2, 50])
def test_chunks_change_no_rows(spark, files, n):
    chunked, whole = read_entries(spark, files["big"], maxKeyElements=n), read_entries(spark, files["big"], chunking=False)
    assert chunked.where("type = 'list'").count() == -(-500 // n) and whole.count() == 3
    for name in ("list", "zset", "hash"):
        assert sorted(rows(table(chunked, name)), key=repr) == sorted(rows(table(whole, name)), key=repr)
    assert table(chunked, "geo").count() == 0 and table(whole, "geo").count() == 200  # only a whole set can be geo
    a, b = ({(r["type"], r["keys"], r["rows"]) for r in summary.type_counts(x).collect()} for x in (chunked, whole))
    assert b == a | {("geo", 1, 200)}
    assert [r[0] for r in rows(table(chunked, "list", order=True).orderBy("file", "seq", "index"), "index")] == list(range(500))


def test_filters(spark, files):
    e = read_entries(spark, files["mixed"])
    keys = lambda df: {bytes(r[0]) for r in df.select("key").collect()}
    assert keys(select_entries(e, db=1)) == keys(read_entries(spark, files["mixed"], db=1)) == {b"empty_list", b"empty_set", b"empty_zset", b"empty_hash"}
    assert keys(select_entries(e, types="geo")) == {b"places", b"small_ints"} and keys(select_entries(e, types="geo", heuristics=frozenset())) == set()
    assert keys(select_entries(e, types="HLL, string")) == keys(e.where("type = 'string'")) == keys(read_entries(spark, files["mixed"], types="hll"))
    assert keys(select_entries(e, types="hll")) == {b"sketch", b"stale"}
    assert keys(select_entries(e, key_pattern="tide_*")) == keys(read_entries(spark, files["mixed"], keyPattern="tide_*")) == {b"tide_note", b"tide_list", b"tide_set", b"tide_zset", b"tide_hash"}
    assert keys(select_entries(e, key_pattern="!*_*")) == {b"ebb", b"places", b"sketch", b"stale", b"mod", b"log", b"hfe", b"\xff\xfe"}
    size = e.where(F.col("key") == b"tide_note").select(C.estimated_bytes()).first()[0]
    assert size == len("tide_note") + len("seven tides")
    assert b"tide_note" in keys(select_entries(e, max_entry_bytes=size)) and b"tide_note" not in keys(select_entries(e, max_entry_bytes=size - 1))
    sizes = {bytes(r[0]): r[1] for r in e.select("key", C.estimated_bytes()).collect()}
    assert sizes[b"tide_list"] == 9 * 3 + 7 and sizes[b"places"] == 6 * 2 + 6 + 5 + 16 and sizes[b"mod"] == 3 * 5 + 4 * 8 + 1 and sizes[b"log"] == 3 * 5 + 5 + 5 + 5 + 2 + 5 + 5 + 5 + 2 and sizes[b"empty_list"] == 10
    assert list(tables(e, "geo")) == ["geo"] and list(tables(e, "zset")) == ["zset"]


@pytest.mark.parametrize("pattern,yes,no", [
    ("user:*", ["user:", "user:a"], ["user:a/b", "xuser:a"]), ("a?c", ["abc", "aéc"], ["a/c", "ac"]), ("**", ["", "a/b/c"], []), ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]), ("a/**", ["a/", "a/b/c"], ["a"]),
    ("**/b", ["b", "a/b", "a/c/b"], ["ab"]), ("[a-c]x", ["ax", "cx"], ["dx", "x"]), ("[!a]x", ["bx"], ["ax"]), ("[^a]x", ["bx"], ["ax"]), ("{a,bc}d", ["ad", "bcd"], ["bd"]), ("{a,b{c,d}}", ["a", "bc", "bd"], ["b"]), ("!a*", ["b"], ["ab"]),
    (r"\*a", ["*a"], ["xa"]), ("a.b", ["a.b"], ["axb"]), ("[]]", ["]"], ["a"]), ("a+(b)", ["a+(b)"], ["aab"]), ("a\nb", ["a\nb"], ["ab"]),
])
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(t.encode(), True) for t in yes] + [(t.encode(), False) for t in no] or [(b"", True)], "key binary, want boolean")
    assert [r[0] for r in df.select(C.key_matches(pattern)).collect()] == [r[0] for r in df.select("want").collect()]


def test_counts(spark, files):
    got = {(r["level"], r["db"], r["type"]): (r["keys"], r["rows"]) for r in summary.counts(read_entries(spark, files["mixed"])).collect()}
    e = read_entries(spark, files["mixed"])
    assert got[("all", None, None)][0] == e.count() == sum(v[0] for k, v in got.items() if k[0] == "db")
    assert got[("type", None, "geo")] == (2, 4) and got[("db", 2, None)] == (9, 16) and got[("db_type", 2, "zset")] == (3, 6)
    for name, df in tables(e).items():
        assert got[("type", None, name)][1] == df.count()


def test_several_files(spark, files):
    e = read_entries(spark, f"{files['folder']}/*.rdb")
    assert e.select("file").distinct().count() == 4 and e.rdd.getNumPartitions() == 5
    both = read_entries(spark, f"{files['basic']},{files['compat']}")
    assert both.count() == 12 and read_info(spark, f"{files['basic']},{files['compat']}").count() == 2


def test_errors(spark, files):
    broken = f"{files['folder']}/broken"
    with pytest.raises(ValueError, match="checksum"):
        api.inspect(spark, f"{broken}/crc.rdb")
    assert api.read(spark, f"{broken}/crc.rdb", verify_crc=False)["string"].count() == 2
    with pytest.raises(OSError, match="ends within"):
        api.inspect(spark, f"{broken}/short.rdb")
    with pytest.raises(ValueError, match="not a snapshot"):
        api.read(spark, f"{broken}/magic.rdb")
    with pytest.raises(OSError, match="no such snapshot"):
        api.read(spark, f"{broken}/absent.rdb")
    for call in (lambda: api.entries(spark, files["basic"], max_key_elements=0), lambda: api.to_parquet(spark, files["basic"], "/tmp/x", compression="zip"), lambda: api.to_parquet(spark, files["basic"], "/tmp/x", row_group_size=0), lambda: api.read(spark, files["basic"], "bad")):
        with pytest.raises(ValueError):
            call()


def test_parsers():
    assert schemas.parse_types(" Hash ,HLL") == {"hash", "hyperloglog"} and schemas.parse_types(None) is None
    assert schemas.parse_heuristics("ALL") == {"geo"} and schemas.parse_heuristics("none") == frozenset() and schemas.format_heuristics(frozenset()) == "none" and schemas.format_heuristics(frozenset({"geo"})) == "geo"
    for call in (lambda: schemas.parse_types("hash,x"), lambda: schemas.parse_heuristics("x"), lambda: sinks.parse_compression("zip")):
        with pytest.raises(ValueError):
            call()
    assert sinks.parse_compression("lz4-raw") == "lz4_raw"
    assert cli.byte_size("50mb") == 50 << 20 and cli.byte_size("2GB") == 2 << 30 and cli.byte_size("7") == cli.byte_size("7b") == 7
    for bad in ("", "0", "-1", "1tb", "99999999999gb"):
        with pytest.raises(Exception):
            cli.byte_size(bad)


def test_read_batches(spark, files):
    got = {}
    for name, batch in api.read_batches(spark, files["mixed"]):
        assert isinstance(batch, pa.RecordBatch)
        got[name] = got.get(name, 0) + batch.num_rows
    assert got == {n: df.count() for n, df in api.read(spark, files["mixed"]).items()} and set(got) == set(schemas.TYPES)


@pytest.mark.parametrize("codec", ["zstd", "snappy", "gzip", "none", "lz4", "lz4-raw"])
def test_export_codecs(spark, files, tmp_path, codec):
    assert api.to_parquet(spark, files["basic"], str(tmp_path), codec)["hash"] == 3
    assert spark.read.parquet(str(tmp_path / "hash.parquet")).count() == 3


def test_export_metadata_and_row_groups(spark, files, tmp_path):
    out = str(tmp_path / "a")
    api.to_parquet(spark, files["big"], out, row_group_size=100, heuristic="none")
    (name,) = [n for n in os.listdir(f"{out}/list.parquet") if n.endswith(".parquet")]
    f = pq.ParquetFile(f"{out}/list.parquet/{name}")
    assert [f.metadata.row_group(i).num_rows for i in range(f.num_row_groups)] == [100] * 5
    meta = {k.decode(): v.decode() for k, v in f.schema_arrow.metadata.items()}
    assert meta["rdb.heuristics"] == "none" and meta["rdb.valkey-ver"] == "8.0.1" and meta["rdb.exported_by"] == sinks.TOOL
    assert summary.exported_heuristics(out) == frozenset()
    out = str(tmp_path / "b")
    api.to_parquet(spark, files["big"], out, heuristic="none")
    assert summary.exported_heuristics(out) == frozenset() and pq.ParquetFile(next(Path(f"{out}/list.parquet").glob("*.parquet"))).schema_arrow.metadata[b"rdb.ctime"] == b"1704067200"
    assert json.load(open(f"{out}/_export_manifest.json"))["rows"] == {"list": 500, "zset": 200, "hash": 2}
    # Of several snapshots, what they agree in.
    written = api.to_parquet(spark, f"{files['basic']},{files['compat']}", str(tmp_path / "c"))
    meta = pq.ParquetFile(next((tmp_path / "c/hash.parquet").glob("*.parquet"))).schema_arrow.metadata
    assert b"rdb.ctime" in meta and b"rdb.valkey-ver" not in meta and b"rdb.redis-ver" not in meta and written["hash"] == 6
    assert len(json.load(open(f"{tmp_path}/c/_export_manifest.json"))["snapshots"]) == 2
    assert summary.exported_heuristics(str(tmp_path / "absent")) == {"geo"}


def test_files_have_the_printed_schema(spark, files, tmp_path):
    """Types, nullability and names of every file and batch are those that the schema command prints."""
    printed = json.loads(schemas.describe(output="json"))
    for form, extension, read in (("parquet", "parquet", pq.read_schema), ("arrow-ipc", "arrow", lambda p: pa.ipc.open_file(p).schema)):
        api.export(spark, files["mixed"], str(tmp_path), form)
        for kind in schemas.TYPES:
            (path,) = (tmp_path / f"{kind}.{extension}").glob(f"*.{extension}")
            assert [{"name": f.name, "type": schemas.PRINTED[f.type], "nullable": f.nullable} for f in read(path)] == printed[kind]
    assert {k for k, b in api.read_batches(spark, files["mixed"]) if b.schema.equals(schemas.arrow_schema(k))} == set(schemas.TYPES)
    back = spark.read.parquet(str(tmp_path / "module.parquet")).where("opcode = 'sint'").first()
    assert back["int_value"] == Decimal(2**64 - 1) and back["db"] == 2
    first = schemas.arrow_schema("string")
    assert (first.field("db").type, first.field("lfu_frequency").type, first.field("num_elements").type, first.field("key").nullable) == (pa.uint32(), pa.uint8(), pa.uint64(), False)
    sinks.write_table(table(read_entries(spark, files["basic"]), "geo"), str(tmp_path / "none.parquet"), "geo")
    assert pq.read_table(tmp_path / "none.parquet").num_rows == 0


@pytest.mark.parametrize("form", ["parquet", "arrow-ipc", "csv", "json"])
def test_a_failed_write_leaves_the_old_export(spark, files, tmp_path, form):
    out = str(tmp_path / f"hash.{form}")
    good = table(read_entries(spark, files["basic"]), "hash")
    sinks.write_table(good, out, "hash", form)
    before = {p.name: p.read_bytes() for p in Path(out).iterdir()}
    bad = good.unionByName(good.withColumn("field", F.when(F.col("num_elements") == 3, F.raise_error(F.lit("no more"))).otherwise(F.col("field"))))
    with pytest.raises(Exception, match="no more"):
        sinks.write_table(bad, out, "hash", form)
    if form in ("parquet", "arrow-ipc"):
        with pytest.raises(ValueError, match="expected"):
            sinks.write_table(good, out, "hash", form, expected=4)
    assert {p.name: p.read_bytes() for p in Path(out).iterdir()} == before and [p.name for p in tmp_path.iterdir()] == [f"hash.{form}"]


def test_skipped_values_are_told(spark, files, tmp_path, capsys):
    written = api.to_parquet(spark, files["mixed"], str(tmp_path / "a"), max_entry_bytes=30)
    sizes = [r[0] for r in read_entries(spark, files["mixed"]).select(C.estimated_bytes()).collect()]
    assert written.skipped == {"unknown_type": 1, "oversized": sum(n > 30 for n in sizes)} and written.skipped["oversized"] > 0
    assert json.load(open(f"{tmp_path}/a/_export_manifest.json"))["skipped"] == written.skipped
    assert cli.main(["export", files["mixed"], "-o", str(tmp_path / "b")]) == 0 and "1 values skipped: unknown type" in capsys.readouterr().err


def test_large_files_are_read_in_parts(spark, files, tmp_path):
    both = f"{files['mixed']},{files['big']}"
    apart = read_entries(spark, both, partBytes=600, maxKeyElements=100)
    assert apart.rdd.getNumPartitions() > 3
    whole = read_entries(spark, both, maxKeyElements=100)
    plain = [c for c in whole.columns if c != "seq"]
    listed = lambda df: sorted(repr(r) for r in df.select(plain).collect())
    assert listed(apart) == listed(whole)
    assert cli.main(["export", files["mixed"], "-o", str(tmp_path / "x"), "--part-bytes", "600b"]) == 0
    assert {r["status"] for r in api.validate(spark, files["mixed"], str(tmp_path / "x"))} == {"ok"}
    assert {k: df.count() for k, df in api.read(spark, files["mixed"], part_bytes=600).items()} == {k: df.count() for k, df in api.read(spark, files["mixed"], part_bytes=0).items()}


def test_tables_decode_their_own_values(spark, tmp_path):
    """A damaged list doesn't matter to who asks for hashes, nor to counting keys."""
    s = basic().add(N.LIST_ZIPLIST, b"torn", E.string(b"\x00\x01\x02"))
    (tmp_path / "torn.rdb").write_bytes(s.bytes())
    got = api.read(spark, str(tmp_path / "torn.rdb"))
    assert set(got) == {"string", "list", "set", "zset", "hash"} and got["hash"].count() == 3
    assert api.inspect(spark, str(tmp_path / "torn.rdb"))["dbs"][0]["types"]["list"] == 2
    with pytest.raises(Exception, match="SNAPSHOT_CORRUPT"):
        got["list"].count()
    shallow = read_entries(spark, str(tmp_path / "torn.rdb"), shallow=True)
    assert {r["type"] for r in shallow.where("str is null and scored is null").collect()} == {"list", "set", "hash"} and shallow.where("elems is not null or fields is not null").count() == 0


def test_unreadable_files(spark, files, tmp_path, capsys):
    """What can't be opened is an input error, what is no whole snapshot a damaged one."""
    from keyquarry.codec.errors import CorruptData, Truncated, Unreadable, from_message

    for kind in (CorruptData, Truncated, Unreadable):
        assert type(from_message(f"Job aborted: {kind('x')}\n more")) is kind
    with pytest.raises(api.SnapshotUnreadableError), api.told():
        raise RuntimeError(f"worker: {Unreadable('/a/b: permission denied')}")
    with pytest.raises(api.SnapshotIOError), api.told():
        raise Truncated("early")
    assert cli.main(["validate", f"{files['folder']}/absent.rdb", str(tmp_path)]) == 3 and cli.main(["validate", f"{files['folder']}/broken/short.rdb", str(tmp_path)]) == 4


def test_text_exports_are_hex(spark, files, tmp_path):
    api.export(spark, files["mixed"], str(tmp_path), "csv", types="string")
    api.export(spark, files["mixed"], str(tmp_path), "json", types="hash")
    lines = [x for p in sorted((tmp_path / "string.csv").glob("*.csv")) for x in p.read_text().splitlines()]
    assert lines[0] == "db,key,type,expiry_ms,lru_idle_secs,lfu_frequency,encoding,num_elements,value" and any(f"0,{b'tide_note'.hex()},string,,,,string,1,{b'seven tides'.hex()}" == x for x in lines)
    docs = [json.loads(x) for p in (tmp_path / "hash.json").glob("*.json") for x in p.read_text().splitlines()]
    assert {"field": b"go".hex(), "field_value": b"2".hex(), "field_expiry_ms": FAR}.items() <= next(d for d in docs if d.get("field") == b"go".hex()).items()
    assert "field" not in next(d for d in docs if d["key"] == b"empty_hash".hex())  # nulls are left out


def test_arrow_export(spark, files, tmp_path):
    api.export(spark, files["mixed"], str(tmp_path), "arrow-ipc")
    with pa.ipc.open_file(next((tmp_path / "hash.arrow").glob("*.arrow"))) as f:
        t = f.read_all()
    assert t.num_rows == 6 and t.schema.names == [f.name for f in schemas.schema_for("hash")]


def test_validate_levels(spark, files, tmp_path):
    out = str(tmp_path)
    api.to_parquet(spark, files["mixed"], out)
    got = api.validate(spark, files["mixed"], out)
    assert [r["type"] for r in got] == list(schemas.TYPES) and {r["status"] for r in got} == {"ok"}
    got = {r["type"]: r["status"] for r in api.validate(spark, files["basic"], out)}
    assert got == {"string": "MISMATCH", "list": "MISMATCH", "set": "MISMATCH", "zset": "MISMATCH", "hash": "MISMATCH", "geo": "EXTRA", "hyperloglog": "EXTRA", "module": "EXTRA", "stream": "EXTRA"}
    assert {r["status"] for r in api.validate(spark, files["basic"], str(tmp_path / "absent"))} == {"MISSING"}


def test_command_line(spark, files, tmp_path, capsys, monkeypatch):
    out = str(tmp_path / "out")
    assert cli.main(["export", files["basic"], "-o", out]) == 0 and cli.main(["validate", files["basic"], out]) == 0
    assert "PASS (5/5)" in capsys.readouterr().err
    assert cli.main(["export", files["basic"], "-o", out]) == 0 and "already holds" in capsys.readouterr().err
    assert cli.main(["validate", files["mixed"], out]) == 5
    assert cli.main(["export", files["mixed"], "-o", out, "--type", "hash,geo", "--db", "2", "--key-pattern", "pl*", "--shard-id", "s1", "-f", "json", "--max-entry-bytes", "1mb", "--no-chunking"]) == 0
    assert "geo.s1.json" in os.listdir(out) and "hash.s1.json" not in os.listdir(out)
    for bad in (["export", files["basic"], "--type", "x"], ["export"], ["export", files["basic"], "--shard-id", "a b"], ["export", files["basic"], "--no-chunking", "--max-key-elements", "5"], ["export", files["basic"], "--heuristic", "x"]):
        assert cli.main(bad) == 2
    assert cli.main(["export", f"{files['folder']}/absent.rdb", "-o", out]) == 3
    for damaged in ("crc", "short", "magic"):
        assert cli.main(["export", f"{files['folder']}/broken/{damaged}.rdb", "-o", str(tmp_path / damaged)]) == 4
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": open(files["basic"], "rb")}))
    assert cli.main(["export", "-", "-o", str(tmp_path / "piped")]) == 0 and (tmp_path / "piped/hash.parquet").exists()
    capsys.readouterr()
    assert cli.main(["schema", "--type", "geo", "--output", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["geo"][0] == {"name": "db", "type": "UInt32", "nullable": False}
    assert cli.main(["schema"]) == 0 and "hyperloglog:" in capsys.readouterr().out


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_parts_of_a_file(spark, files, size):
    whole = read_entries(spark, f"{files['mixed']},{files['big']}", maxKeyElements=50)
    parts = find_parts(spark, f"{files['mixed']},{files['big']}", size)
    apart = read_parts(parts, maxKeyElements=50)
    spans = {}
    for r in parts.orderBy("file", "part").collect():
        spans.setdefault(r["file"], []).append((r["start"], r["end"]))
    assert all(a[1] == b[0] for v in spans.values() for a, b in zip(v, v[1:])) and sum(map(len, spans.values())) >= {1: 20, 300: 4}.get(size, 2)
    plain = [c for c in whole.columns if c != "seq"]
    listed = lambda df: [repr(r) for r in df.orderBy("file", "seq").select(plain).collect()]
    assert listed(apart) == listed(whole)
    assert read_parts(parts, db=2).count() == read_entries(spark, files["mixed"], db=2).count()


def test_parts_of_damaged_and_empty_files(spark, files):
    assert find_parts(spark, files["empty"], 10).collect() == []
    with pytest.raises(Exception, match="SNAPSHOT_CORRUPT"):
        find_parts(spark, f"{files['folder']}/broken/crc.rdb", 10)
    assert find_parts(spark, f"{files['folder']}/broken/crc.rdb", 10, verify_crc=False).count() > 1

"""Decoding of hand-made bytes: values, limits and damage."""

import io
import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyquarry.codec import names as N
from keyquarry.codec import batches, packed, reader
from keyquarry.codec.crc64 import crc64, shift
from keyquarry.codec.errors import CorruptData, InvalidMagic, Truncated, UnsupportedVersion, from_message
from keyquarry.codec.streams import entries_of
from testkit import encoder as E


def read(data, **kw):
    return list(reader.SnapshotReader(io.BytesIO(data), **kw))


def one(code, body, **kw):
    (e,) = read(E.Snapshot().add(code, b"k", body).bytes(), **kw)
    return e.value


def source(data):
    return reader.Source(io.BytesIO(data))


# Checksum


def test_crc_known_value():
    assert crc64(b"123456789") == 0xE9C6D914C4B8D9CA and crc64(b"") == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 3000))
def test_crc_in_parts(data, at):
    assert crc64(data[at:], crc64(data[:at])) == crc64(data)
    slow = 0
    for i in range(0, len(data), 50):
        slow = crc64(data[i : i + 50], slow)
    assert slow == crc64(data) and shift(5, 7) == crc64(bytes(7), 5)


@pytest.mark.parametrize("block", [16, 1000])
def test_crc_over_refills(monkeypatch, block):
    monkeypatch.setattr(reader, "BLOCK", block)
    s = E.Snapshot()
    for i in range(300):
        s.add(N.STRING, b"key%d" % i, E.string(b"v" * i))
    r = reader.SnapshotReader(io.BytesIO(s.bytes()))
    assert len(list(r)) == 300 and r.crc_checked


def test_crc_policy():
    good = E.Snapshot().add(N.STRING, b"k", E.string(b"v"))
    r = reader.SnapshotReader(io.BytesIO(good.bytes(crc=1)))
    seen = []
    with pytest.raises(CorruptData):
        for e in r:
            seen.append(e)
    assert len(seen) == 1  # the mismatch shows after the entries
    r = reader.SnapshotReader(io.BytesIO(good.bytes(crc=0)))
    assert len(list(r)) == 1 and not r.crc_checked
    assert len(read(good.bytes(crc=1), verify_crc=False)) == 1
    old = E.Snapshot("REDIS", 4).add(N.STRING, b"k", E.string(b"v"))
    assert len(read(old.bytes(crc=1))) == 1 and len(read(old.bytes()[:-8])) == 1
    assert len(read(good.bytes() + b"after")) == 1


# Header and metadata


@pytest.mark.parametrize("head,error", [(b"REDIS0000", UnsupportedVersion), (b"REDIS0012", UnsupportedVersion), (b"VALKEY012", UnsupportedVersion), (b"VALKEY081", UnsupportedVersion), (b"REDIS00x1", InvalidMagic), (b"NOTADUMP1", InvalidMagic), (b"REDI", Truncated), (b"", Truncated)])
def test_bad_headers(head, error):
    with pytest.raises(error) as e:
        read(head)
    assert type(from_message(f"something {e.value}")) is error


@pytest.mark.parametrize("magic,version", [("REDIS", v) for v in range(1, 12)] + [("VALKEY", 80)])
def test_good_headers(magic, version):
    r = reader.SnapshotReader(io.BytesIO(E.Snapshot(magic, version, {}).bytes()))
    assert (r.header.magic, r.header.version, list(r)) == (magic, version, [])


def test_metadata():
    r = reader.SnapshotReader(io.BytesIO(E.Snapshot(aux={"redis-ver": "7.0", "valkey-ver": "8.0", "ctime": "12", "used-mem": "x", "repl-offset": "-5", "repl-id": "abc"}).raw(b"\xfa" + E.string(b"ctime") + E.string(b"13") + b"\xfa" + E.string(b"odd") + E.string(b"\xff")).bytes()))
    h = r.header
    assert (h.server_version, h.ctime, h.used_mem, h.repl_offset, h.repl_id, h.aux["odd"]) == ("8.0", 13, None, -5, "abc", "�")
    assert reader.Header("REDIS", 9, {"redis-ver": "7.2"}).server_version == "7.2" and reader.Header("REDIS", 9).server_version is None
    assert reader.Header("REDIS", 9, {"ctime": "1_0"}).ctime is None
    with pytest.raises(CorruptData):
        read(E.Snapshot(aux={}).raw(b"\xfa" + E.string(b"\xff") + E.string(b"x")).bytes())


# Lengths, strings, doubles


@pytest.mark.parametrize("n", [0, 63, 64, 16383, 16384, 2**32 - 1, 2**32, 2**64 - 1])
def test_lengths(n):
    assert source(E.length(n)).length() == n


def test_bad_lengths():
    for raw in (b"\x82", b"\xbf", b"\xc0\x01"):
        with pytest.raises(CorruptData):
            source(raw).length()
    with pytest.raises(CorruptData):
        source(E.length(N.MAX_ALLOCATION + 1)).string()
    with pytest.raises(Truncated):
        source(b"\x05ab").string()


@pytest.mark.parametrize("n", [0, 5, -128, 127, 128, -32768, 32767, 40000, -(2**31), 2**31 - 1])
def test_int_strings(n):
    assert source(E.int_string(n)).string() == b"%d" % n


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200) | st.text(alphabet="ab", max_size=400).map(str.encode))
def test_lzf_round_trip(data):
    assert packed.lzf_decompress(E.lzf(data), len(data)) == data


def test_lzf_damage():
    raw = b"a" * 60
    assert source(E.lzf_string(raw)).string() == raw
    for data, size in ((E.lzf(raw), 59), (E.lzf(raw), 61), (b"\x05ab", 6), (b"\x20\x05", 3), (b"\x20", 3), (b"\xe0", 9), (b"\x00a", 5000)):
        with pytest.raises(CorruptData):
            packed.lzf_decompress(data, size)
    with pytest.raises(CorruptData):
        source(b"\xc4").string()


@pytest.mark.parametrize("raw,value", [(b"\xfe", math.inf), (b"\xff", -math.inf), (b"\x031.5", 1.5), (b"\x03inf", math.inf), (b"\x04-inf", -math.inf), (b"\x051e300", 1e300)])
def test_text_doubles(raw, value):
    assert source(raw).text_double() == value


def test_odd_text_doubles():
    assert math.isnan(source(b"\xfd").text_double()) and math.isnan(source(b"\x03NaN").text_double())
    for bad in (b"\x031_0", b"\x03 1 ", b"\x00", b"\x02zz"):
        with pytest.raises(CorruptData):
            source(bad).text_double()


# Packed values


NUMBERS = [0, 1, 12, 13, 63, 64, 127, 128, -1, -100, 4095, 4096, -4096, -4097, 32767, -32768, 8388607, -8388608, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63)]


@pytest.mark.parametrize("make,parse", [(E.listpack, packed.listpack), (E.ziplist, packed.ziplist)])
def test_lists_round_trip(make, parse):
    elements = [b"", b"x", b"y" * 63, b"y" * 64, b"z" * 127, b"z" * 4095, b"w" * 16383, b"w" * 16384, b"w" * 70000, b"\xff\x00"]
    assert parse(make(elements)) == elements
    assert parse(make(NUMBERS)) == [b"%d" % n for n in NUMBERS] and parse(make(NUMBERS), numbers=True) == NUMBERS
    assert parse(make([])) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80) | st.integers(-(2**63), 2**63 - 1), max_size=30))
def test_lists_any(elements):
    text = [b"%d" % e if isinstance(e, int) else e for e in elements]
    assert packed.listpack(E.listpack(elements)) == text and packed.ziplist(E.ziplist(elements)) == text


def test_listpack_damage():
    good = E.listpack([b"abc", 5])
    bad = [good[:-1], good[:6] + b"\xff", good + b"x", b"\x08" + good[1:], good[:-1] + b"\xf5", b"", good[:4]]
    wrong = bytearray(good)
    wrong[10] = 9  # the length behind the first entry
    for raw in [*bad, bytes(wrong), struct.pack("<IH", 8, 0) + b"\xff\x00", struct.pack("<IH", 8, 1) + b"\x85\xff", struct.pack("<IH", 9, 1) + b"\xf5\x01\xff"]:
        with pytest.raises(CorruptData):
            packed.listpack(raw)
    long = bytearray(E.listpack([b"z" * 200]))
    long[-2] &= 0x7F  # the second byte of a longer length must go on
    with pytest.raises(CorruptData):
        packed.listpack(bytes(long))


def test_ziplist_damage():
    good = E.ziplist([b"abc", 5])
    assert packed.ziplist(struct.pack("<I", len(good) + 3) + good[4:] + b"abc") == [b"abc", b"5"]  # what follows the end is passed over
    for raw in (good[:-1], struct.pack("<I", len(good) - 1) + good[4:-1], good + b"x", b"", struct.pack("<IIH", 13, 10, 1) + b"\x00\x81\xff", struct.pack("<IIH", 13, 10, 1) + b"\x00\x05a", struct.pack("<IIH", 13, 10, 1) + b"\x00\xc0a", struct.pack("<IIH", 13, 10, 1) + b"\x00\xf0a"):
        with pytest.raises(CorruptData):
            packed.ziplist(raw)


def test_intset():
    for ns in ([], [-100, -1, 0, 42, 1000], [-(2**31), 5], [-(2**63), 2**63 - 1]):
        assert packed.intset(E.intset(ns)) == [b"%d" % n for n in ns]
    good = E.intset([1, 2])
    for raw in (good[:-1], good + b"x", b"\x03" + good[1:], good[:3], struct.pack("<II", 2, N.MAX_INTSET + 1)):
        with pytest.raises(CorruptData):
            packed.intset(raw)


def test_pairs():
    assert packed.field_pairs([b"a", b"1"]) == [(b"a", b"1", None)]
    assert packed.scored_pairs([b"a", b"1.5", 7, 3]) == [(b"a", 1.5), (b"7", 3.0)]
    for call, x in ((packed.field_pairs, [b"a"]), (packed.scored_pairs, [b"a"]), (packed.scored_pairs, [b"a", b"x"])):
        with pytest.raises(CorruptData):
            call(x)


# Every type code


TEXTS = [b"alpha", b"7", b"-500", b""]
FIELDS = [(b"valve", b"north"), (b"turns", b"10")]
SCORES = [(b"first", 1.5), (b"second", -2.25), (b"third", 3.0)]


@pytest.mark.parametrize("code,body,value", [
    (N.STRING, E.string(b"v"), b"v"), (N.STRING, E.int_string(-7), b"-7"), (N.STRING, E.lzf_string(b"ab" * 50), b"ab" * 50),
    (N.LIST, E.plain_strings(TEXTS), TEXTS), (N.LIST_ZIPLIST, E.string(E.ziplist(TEXTS)), TEXTS), (N.LIST_QUICKLIST, E.quicklist1(TEXTS, 2), TEXTS),
    (N.LIST_QUICKLIST_2, E.quicklist2([*TEXTS, b"x" * 9000, b"y"], 2), [*TEXTS, b"x" * 9000, b"y"]), (N.LIST_QUICKLIST_2, E.length(0), []),
    (N.SET, E.plain_strings(TEXTS), TEXTS), (N.SET_LISTPACK, E.string(E.listpack(TEXTS)), TEXTS), (N.SET_INTSET, E.string(E.intset([3, -1])), [b"-1", b"3"]),
    (N.HASH, E.length(2) + b"".join(E.string(f) + E.string(v) for f, v in FIELDS), [(*p, None) for p in FIELDS]),
    (N.HASH_ZIPLIST, E.string(E.ziplist([x for p in FIELDS for x in p])), [(*p, None) for p in FIELDS]), (N.HASH_LISTPACK, E.string(E.listpack([x for p in FIELDS for x in p])), [(*p, None) for p in FIELDS]),
    (N.HASH_2, E.length(2) + E.string(b"a") + E.string(b"1") + struct.pack("<q", -1) + E.string(b"b") + E.string(b"2") + struct.pack("<q", 99), [(b"a", b"1", None), (b"b", b"2", 99)]),
    (N.ZSET, E.length(3) + b"".join(E.string(m) + E.text_score(s) for m, s in SCORES), SCORES), (N.ZSET_2, E.length(3) + b"".join(E.string(m) + struct.pack("<d", s) for m, s in SCORES), SCORES),
    (N.ZSET_ZIPLIST, E.string(E.ziplist([x for m, s in SCORES for x in (m, E.score_text(s))])), SCORES), (N.ZSET_LISTPACK, E.string(E.listpack([x for m, s in SCORES for x in (m, E.score_text(s))])), SCORES),
    (N.MODULE_2, E.module("test-mod_", 1023, [("sint", 2**64 - 5), ("uint", 5), ("float", 0.5), ("double", 2.5), ("string", b"s")]), ("test-mod_", 1023, [("sint", 2**64 - 5, None, None), ("uint", 5, None, None), ("float", None, 0.5, None), ("double", None, 2.5, None), ("string", None, None, b"s")])),
    (N.MODULE_2, E.module("AAAAAAAAA", 0, []), ("AAAAAAAAA", 0, [])),
])
def test_values(code, body, value):
    assert one(code, body) == value
    after = E.Snapshot().add(code, b"k", body).add(N.STRING, b"next", E.string(b"n"))
    assert [e.key for e in read(after.bytes(), wanted=lambda db, key, c: key == b"next")] == [b"next"]  # skipping stays in step


LOG = [(1690001112223, 0, [(b"valve", b"north"), (b"turns", b"17")]), (1690001112230, 4, [(b"valve", b"south"), (b"turns", b"-8")]), (1690001112230, 7, [(b"other", b"x")]), (1690001112299, 0, [])]


@pytest.mark.parametrize("code", [N.STREAM_1, N.STREAM_2, N.STREAM_3])
@pytest.mark.parametrize("deleted", [(), (1,)])
def test_streams(code, deleted):
    body = E.stream(LOG, code, 2, E.consumer_groups(code, (b"g1", b"g2")), deleted)
    live = [e for i, e in enumerate(LOG) if i not in deleted]
    want = (len(live), "1690001112299-0", [(f"{m}-{s}", fields) for m, s, fields in live])
    s = E.Snapshot().add(code, b"k", body).add(N.STRING, b"next", E.string(b"n"))
    first, second = read(s.bytes())
    assert first.value == want and second.key == b"next"
    assert len(read(s.bytes(), wanted=lambda db, key, c: key == b"next")) == 1
    assert one(code, E.stream([], code)) == (0, "0-0", [])


def test_stream_damage():
    master = struct.pack(">QQ", 5, 0)
    ok = [1, 0, 1, b"f", 0, 2, 0, 0, b"v", 4]
    assert entries_of(master, E.listpack(ok)) == [("5-0", [(b"f", b"v")])]
    for items in ([], [1, 0], [1, 0, 1, b"f", 1, 2, 0, 0, b"v", 4], ok[:-2], [*ok, 1], [1, 0, 1, b"f", 0, 2, -1, 0, b"v", 4], [b"x", *ok[1:]], [1, 0, 9, b"f"], [1, 0, 0, 0, 0, 0, 0, 9, b"a"]):
        with pytest.raises(CorruptData):
            entries_of(master, E.listpack(items))
    for raw in (master[:-1], struct.pack(">QQ", 2**64 - 1, 0)):
        with pytest.raises(CorruptData):
            entries_of(raw, E.listpack([1, 0, 1, b"f", 0, 2, 1, 0, b"v", 4]))
    with pytest.raises(CorruptData):
        entries_of(master, E.listpack(ok), room=0)
    nodes = E.length(1) + E.string(master) + E.string(E.listpack(ok))
    with pytest.raises(CorruptData):  # states two entries, has one
        one(N.STREAM_1, nodes + E.length(2) + E.length(5) + E.length(0) + E.length(0))


@pytest.mark.parametrize("code,body", [(N.MODULE_PRE_GA, b""), (N.MODULE_2, E.length(1) + b"\x09"), (N.LIST_QUICKLIST_2, E.length(1) + b"\x03" + E.string(b"")), (N.HASH_LISTPACK, E.string(E.listpack([b"a"]))), (N.LIST, E.length(N.MAX_ALLOCATION + 1))])
def test_damaged_values(code, body):
    with pytest.raises(CorruptData):
        one(code, body)


def test_module_limits(monkeypatch):
    body = E.module("testparts", 1, [("string", b"abc"), ("uint", 1)])
    for name, n in (("MAX_MODULE_VALUES", 1), ("MAX_MODULE_BYTES", 2)):
        with monkeypatch.context() as m:
            m.setattr(N, name, n)
            with pytest.raises(CorruptData):
                one(N.MODULE_2, body)
            s = E.Snapshot().raw(b"\xf7" + E.length(1) + E.length(2) + E.length(0) + body[len(E.length(E.module_id("testparts", 1))) :]).add(N.STRING, b"k", E.string(b"v"))
            assert len(read(s.bytes())) == 1  # what is passed over has no limits


# State between entries


def test_pending_state_is_used_up():
    s = E.Snapshot().add(N.HASH_ZIPMAP, b"z", E.string(b"blob"), expiry_ms=5, idle=6, freq=7).add(N.STRING, b"k", E.string(b"v"))
    r = reader.SnapshotReader(io.BytesIO(s.bytes()))
    (e,) = list(r)
    assert (e.key, e.expiry_ms, e.idle, e.freq, r.skipped_unknown) == (b"k", None, None, None, 1)
    s = E.Snapshot().add(N.STRING, b"skip", E.string(b"v"), expiry_ms=5).add(N.STRING, b"k", E.string(b"v"))
    assert read(s.bytes(), wanted=lambda db, key, c: key == b"k")[0].expiry_ms is None


def test_opcodes():
    s = E.Snapshot().raw(b"\xfb\x01\x02").raw(b"\xf5" + E.string(b"function")).raw(b"\xf4\x01\x02\x03").raw(b"\xf3" + E.string(b"job") + b"\x02\x01\x02\x03\x04")
    s.raw(b"\xfd" + struct.pack("<i", -5)).add(N.STRING, b"a", E.string(b"v"), idle=2**63, freq=255)
    s.add(N.STRING, b"b", E.string(b"v"), db=2**32 - 1, expiry_ms=4102444800000).raw(b"\xfa" + E.string(b"late") + E.string(b"x"))
    a, b = read(s.bytes())
    assert (a.expiry_ms, a.idle, a.freq, a.db, b.expiry_ms, b.db) == (-5000, 2**63, 255, 0, 4102444800000, 2**32 - 1)
    for bad in (b"\xf6", b"\xc8", b"\x08", b"\xfe" + E.length(2**32)):
        with pytest.raises(CorruptData):
            read(E.Snapshot().raw(bad).add(N.STRING, b"k", E.string(b"v")).bytes())
    with pytest.raises(Truncated):
        read(E.Snapshot().add(N.STRING, b"k", E.string(b"v")).bytes()[:-20])


# Chunks


@pytest.mark.parametrize("code,item", [(N.LIST, lambda i: E.string(b"%d" % i)), (N.SET, lambda i: E.string(b"%d" % i)), (N.HASH, lambda i: E.string(b"f%d" % i) + E.string(b"v")), (N.ZSET, lambda i: E.string(b"%d" % i) + E.text_score(i)), (N.ZSET_2, lambda i: E.string(b"%d" % i) + struct.pack("<d", i)), (N.HASH_2, lambda i: E.string(b"f%d" % i) + E.string(b"v") + struct.pack("<q", i))])
def test_chunks(code, item):
    body = E.length(7) + b"".join(map(item, range(7)))
    data = E.Snapshot().add(code, b"k", body, expiry_ms=9).add(N.STRING, b"next", E.string(b"n")).bytes()
    *chunks, last = read(data, max_key_elements=3)
    assert [(c.total, c.offset, len(c.value), c.expiry_ms) for c in chunks] == [(7, 0, 3, 9), (7, 3, 3, 9), (7, 6, 1, 9)] and last.key == b"next"
    for n in (7, 8, None):
        whole, _ = read(data, max_key_elements=n)
        assert whole.total is None and whole.offset is None and whole.value == [x for c in chunks for x in c.value]
    with pytest.raises(ValueError):
        read(data, max_key_elements=0)


def test_packed_values_are_never_chunked():
    (e,) = read(E.Snapshot().add(N.HASH_LISTPACK, b"k", E.string(E.listpack([b"a", b"1", b"b", b"2"]))).bytes(), max_key_elements=1)
    assert len(e.value) == 2 and e.total is None


# Listpacks of many keys at once


@pytest.mark.parametrize("gather", [batches.GATHER, 100])
def test_listpacks_together(monkeypatch, gather):
    """Of each kind of element, of some length, of many and few listpacks: what the reader of single ones gives."""
    monkeypatch.setattr(batches, "GATHER", gather)
    rnd = random.Random(7)
    kinds = [lambda: b"", lambda: b"%d" % rnd.choice([0, 1, 127, 128, -1, 4095, -4096, 4096, -(2**15), 2**15, 2**23 - 1, -(2**23), 2**31 - 1, -(2**31), 2**63 - 1, -(2**63)]), lambda: rnd.randbytes(rnd.randint(1, 63)), lambda: rnd.randbytes(rnd.choice([64, 126, 127, 128, 4095, 5000])), lambda: b"007", lambda: b"text"]
    for n in (0, 1, 60, 400):
        blobs = [E.listpack([rnd.choice(kinds if rnd.random() < 0.1 else kinds[:3])() for _ in range(rnd.randint(0, 30))]) for _ in range(n)]
        counts, elements = batches.listpacks(blobs)
        want = [packed.listpack(b) for b in blobs]
        assert counts.tolist() == [len(w) for w in want] and elements.to_pylist() == [e for w in want for e in w]
    good = [E.listpack([b"a", b"%d" % i]) for i in range(100)]
    for bad in (b"", good[0][:-1], good[0][:4] + b"\x00\x00" + good[0][6:-2] + b"\x05\xff", b"\x08\x00\x00\x00\x01\x00\x05\x05", good[0][:6] + b"\xff" + good[0][7:]):
        with pytest.raises(CorruptData):
            batches.listpacks([*good, bad])

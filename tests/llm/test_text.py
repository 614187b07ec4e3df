"""Encoding, mixing and splitting against a second tokenizer library and plain Python."""

import base64
import random
import re

import compare
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyquarry.llm import bpe, mixing, queries, splitting

SMALL = f"{compare.DATA}/sf0.001"


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.tokenizer_path(), "rb"))}
    return tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(bpe.tokenizer_path())


ODD = ["", " ", "   ", "\n\n  a", "a\x1cb !\x1c!", "\x85x\xa0y", "a b　c", "it's we'll I'D", "12 345٣४", "é é ñ", "中文 テスト 한국어", "🌿🌿 👩‍👩‍👧", "\x00\x01\x7f", "\r\n\r\nfoo\r\n", "<|endoftext|> x", "a" * 5000, " " * 3000, "\t" * 700 + "x", "!?" * 2000, "A​B C᠎D﻿E", "<unk> ▁ ▁▁x", "\u001f \u001e a\u001d", "İıſK", "²³ ½ Ⅷ"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, other, text):
    ids = own.encode(text).tolist()
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text and own.count(text) == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\t\x0b\x1c\x85\xa0aB1.'s- 　é中", max_size=60))
def test_any_text(own, other, text):
    text = text.encode("utf-8", "replace").decode()
    assert own.encode(text).tolist() == other.encode_ordinary(text)


def test_memory_starts_anew(own, other, monkeypatch):
    monkeypatch.setattr(bpe, "PARTS", 3)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    texts = ["one two three", None, "four five one two", "", "x" * 60 + " one", "six", "seven eight nine ten eleven"] * 3
    assert [x.tolist() for x in own.encode_all(texts)] == [other.encode_ordinary(t or "") for t in texts]
    assert own.count_all(texts) == [len(other.encode_ordinary(t or "")) for t in texts] and all(len(p) <= bpe.PART_CHARS for p in own._known)


def test_ids_of_whole_table(spark, other):
    rows = queries.p8_ids(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == other.encode_ordinary(texts[r["doc_id"]] or "")


def test_ids_nulls_and_round_trip(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "héllo\n wörld"), (3, "héllo\n wörld")], "doc_id bigint, text string")
    rows = df.select("doc_id", "text", bpe.token_ids(F.col("text")).alias("ids"), bpe.token_count(F.col("text")).alias("n")).withColumn("back", bpe.decoded(F.col("ids"))).collect()
    assert [r["ids"] for r in rows[:2]] == [[], []] and [r["n"] for r in rows[:2]] == [0, 0]
    assert all(r["back"] == r["text"] and r["n"] == len(r["ids"]) for r in rows[2:])
    assert df.limit(0).select(bpe.token_ids(F.col("text"))).collect() == []


# Splitting


def cut(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("piece_no", F.lit("clash")).withColumn("__key", F.lit(0))
    out = {}
    for r in splitting.split_oversized(df, **kw).collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def check_pieces(text, pieces, own, limit, overlap):
    ids = own.encode(text).tolist()
    assert pieces[0]["start_token"] == 0 and pieces[-1]["end_token"] == len(ids)
    raw = text.encode()
    for a, b in zip(pieces, pieces[1:]):
        assert b["start_token"] == a["end_token"] - overlap and b["end_token"] > a["end_token"]
    for p in pieces:
        assert p["n_tokens"] == p["end_token"] - p["start_token"] <= limit
        assert raw[p["start_byte"] : p["end_byte"]] == own.decode_bytes(ids[p["start_token"] : p["end_token"]])
        if p["cut"] == "line":
            rest = raw[p["end_byte"] :]
            assert raw[: p["end_byte"]].endswith(b"\n") or re.match(rb"\s*\n", rest)
        if p["cut"] in ("file", "hunk"):
            assert re.match(rb"\s*(diff --git |@@ )", raw[p["end_byte"] :])


def test_split_commits(spark, own):
    random.seed(3)
    line = lambda: "+" + " ".join("".join(random.choices("abcdefgh_()", k=random.randint(2, 9))) for _ in range(random.randint(1, 9)))
    hunk = lambda: "@@ -1,2 +3,4 @@\n" + "".join(line() + "\n" for _ in range(random.randint(2, 30)))
    file = lambda: "diff --git a/x b/x\n" + "".join(hunk() for _ in range(random.randint(1, 5)))
    texts = ["commit 1\n\n" + "".join(file() for _ in range(12)), "no boundary " * 700, "x" * 9000, "🌿" * 900, "\n" * 4000, "short", "", None, "commit 1\r\n" + "line\r\n" * 900]
    got = cut(spark, texts, limit=300, overlap=20)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(own.encode(t)) > 300}
    for i, pieces in got.items():
        check_pieces(texts[i], pieces, own, 300, 20)
    kinds = {p["cut"] for p in got[0]}
    assert kinds <= {"file", "hunk", "line", "end"} and len(kinds) > 2
    assert {p["cut"] for p in got[1]} == {"hard", "end"}


def test_pieces_fit_by_themselves(spark, own):
    rows = queries.p10_pieces(spark, f"{compare.DATA}/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{compare.DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in rows} == {d for d, t in texts.items() if t and own.count(t) > 2048}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert own.count(r["piece"]) <= 2048
    for d, pieces in by.items():
        check_pieces(texts[d], sorted(pieces, key=lambda r: r["piece_no"]), own, 2048, 128)


def test_found_long_documents(spark, own):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r[0] for r in queries.p10_found(spark, SMALL).collect()) == sorted(d for d, t in texts.items() if t and own.count(t) > 2048)


def test_split_edges(spark):
    assert cut(spark, [None, "", "a b"], limit=2, overlap=0) == {} and cut(spark, [], limit=2, overlap=0) == {}
    with pytest.raises(ValueError):
        cut(spark, ["x"], limit=5, overlap=5)


# Mixing

L = mixing.Leaf


def test_allocate_flat():
    leaves = [L(("a",), 2, 1, 100), L(("b",), 1, 1, 1000), L(("c",), 1, 1, 1000), L(("d",), 0, 9, 1000), L(("e",), 1, 3, 0)]
    got = mixing.allocate(leaves, 500)
    assert got == pytest.approx({("a",): 100, ("b",): 200, ("c",): 200, ("d",): 0, ("e",): 0})
    assert mixing.allocate([], 10) == {}
    assert mixing.allocate([L(("a",), 1, 1, 10)], 50) == {("a",): 10}


def test_shortage_goes_to_siblings_first():
    leaves = [L(("code", "en", "x"), 1, 1, 10), L(("code", "en", "y"), 1, 1, 1000), L(("code", "de", "z"), 2, 1, 1000), L(("prose", "en", "w"), 4, 1, 1000)]
    got = mixing.allocate(leaves, 800)
    assert got == pytest.approx({("code", "en", "x"): 10, ("code", "en", "y"): 190, ("code", "de", "z"): 200, ("prose", "en", "w"): 400})
    short = [L(("code", "en", "x"), 1, 1, 10), L(("code", "en", "y"), 1, 1, 20), L(("code", "de", "z"), 2, 1, 1000), L(("prose", "en", "w"), 4, 1, 1000)]
    assert mixing.allocate(short, 800) == pytest.approx({("code", "en", "x"): 10, ("code", "en", "y"): 20, ("code", "de", "z"): 370, ("prose", "en", "w"): 400})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.tuples(st.sampled_from("ab"), st.sampled_from("cd"), st.sampled_from("efgh")), st.integers(0, 9), st.integers(0, 4), st.integers(0, 99)), max_size=12, unique_by=lambda x: x[0]), st.integers(0, 2000))
def test_budgets_add_up(spec, total):
    leaves = [L(p, float(w), r, t) for p, w, r, t in spec]
    got = mixing.allocate(leaves, float(total))
    room = sum(x.capacity for x in leaves if x.weight > 0)
    assert all(got[x.path] <= x.capacity + 1e-6 for x in leaves)
    assert sum(got.values()) == pytest.approx(min(total, room), abs=1e-6)


def test_draw(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 5)
    random.seed(5)
    sizes = [(i, random.choice("aaabc"), random.randint(0, 40)) for i in range(600)] + [(-1, None, 50), (-2, "a", 0)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 3.0, 3), ("c", None, 2), ("zz", 2.0, 5), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    leaves = mixing.read_leaves(df, targets, ["source"])
    total = sum(n for _, _, n in sizes)
    planned = mixing.plan(leaves, total)
    assert {p["leaf"].path[0]: p["short"] for p in planned} == {"a": False, "b": 3 * sum(n for _, s, n in sizes if s == "b") < total / 2, "c": False, "zz": True}
    rows = mixing.draw(df, planned, ["source"], seed=7).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    for p in planned:
        mine = [r for r in rows if r["source"] == p["leaf"].path[0]]
        used = sum(r["n_tokens"] * r["times"] for r in mine)
        assert all(r["times"] <= p["leaf"].max_repeats for r in mine) and used <= p["budget"]
        if p["budget"]:
            assert p["budget"] - used <= 40
            assert max(r["times"] for r in mine) - min(r["times"] for r in mine) <= 1
    again = mixing.draw(df.repartition(7), planned, ["source"], seed=7).collect()
    assert {(r["doc_id"], r["times"]) for r in again} == {(r["doc_id"], r["times"]) for r in rows}
    other = mixing.draw(df, planned, ["source"], seed=8).collect()
    assert {(r["doc_id"], r["times"]) for r in other} != {(r["doc_id"], r["times"]) for r in rows}


def test_draw_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    planned = mixing.plan(mixing.read_leaves(df, targets, ["source"]), 0)
    assert mixing.draw(df, planned, ["source"]).collect() == []
    assert mixing.plan(mixing.read_leaves(df, targets.limit(0), ["source"]), 0) == []


def test_short_sources(spark, own):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("source", "text").collect()
    targets = spark.read.parquet(f"{SMALL}/mix_target.parquet").collect()
    tokens = {}
    for r in docs:
        tokens[r["source"]] = tokens.get(r["source"], 0) + own.count(r["text"])
    total, weights = sum(tokens.values()), sum(t["weight"] for t in targets)
    want = {t["source"] for t in targets if t["max_repeats"] * tokens.get(t["source"], 0) < t["weight"] / weights * total}
    assert {r[0] for r in queries.p9_found(spark, SMALL).collect()} == want


def test_shares_reached(spark):
    rows = queries.p9_mix(spark, f"{compare.DATA}/sf0.01").collect()
    assert sum(r["reached"] for r in rows) == pytest.approx(1)
    for r in rows:
        assert r["drawn"] <= r["budget"] <= r["max_repeats"] * r["tokens"] and r["most_times"] <= r["max_repeats"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "don't", " ", "  ", "\n", "\n\n", "\t", "'s", "--'", "é", "🌿", "　", "\xa0", "123", "x" * 40, "(", "\r\n"]), min_size=1, max_size=60), st.data())
def test_own_length(own, parts, data):
    """Encoding a piece's ends again gives what encoding the whole piece gives."""
    raw = "".join(parts).encode()
    ids = own.encode(raw.decode())
    offsets = np.concatenate([[0], np.cumsum(own.sizes[ids])])
    a = data.draw(st.integers(0, len(ids) - 1))
    b = data.draw(st.integers(a + 1, len(ids)))
    assert splitting.own_length(own, raw, offsets, a, b) == own.count(raw[offsets[a] : offsets[b]].decode("utf-8", "replace"))


def test_work_grows_with_length(own):
    """Twice the text takes about twice the calls and bytes, whatever its length."""
    line = "+ some changed line of code(arg, 17)\n"
    seen = []

    class Counting:
        sizes = own.sizes

        def count(self, text):
            seen.append(len(text))
            return own.count(text)

    def work(n):
        seen.clear()
        raw = (line * n).encode()
        assert len(splitting.pieces_of(Counting(), raw, own.encode(raw.decode()), 2048, 128, [(k, re.compile(p, re.M)) for k, p in splitting.BOUNDARIES])) > 1
        return sum(seen)

    assert work(8000) <= 2.2 * work(4000) and work(8000) < 8000 * len(line) / 20


def test_boundaries_are_parameters(spark):
    text = "one two three. " * 80
    got = cut(spark, [text], limit=50, overlap=0, boundaries=[("sentence", rb"(?<=\. )")])
    assert {p["cut"] for p in got[0]} == {"sentence", "end"} and "".join(p["piece"] for p in got[0]) == text
    assert {p["cut"] for p in cut(spark, [text], limit=50, overlap=0)[0]} == {"hard", "end"}
    bare = splitting.split_oversized(spark.createDataFrame([(1, text)], "doc_id int, text string"), limit=50, overlap=0, texts=False)
    assert "piece" not in bare.columns and [r["end_token"] for r in bare.orderBy("piece_no").collect()] == [p["end_token"] for p in cut(spark, [text], limit=50, overlap=0)[0]]

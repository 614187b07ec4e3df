"""What changed between consecutive full snapshots.

Keys get lasting ordinals, kept in a dictionary, a table that later runs read and add to. A snapshot's keys are a bitmap of
ordinals, of which only the non-empty 64-bit words are kept, each with the vector of its payloads, aligned to its bits.
AND-NOT of a word with the same word of the snapshot before gives additions, the reverse removals; the vectors are
compared at the bits that both words have. Key columns are looked up for the ordinals that changed, only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import fresh_path, materialize, null_safe, small_table
from .snapshots import usable_snapshots

#: Ordinals of one bitmap word.
WORD = 64
#: Seeds of the two 64-bit hashes that stand for a payload. That two payloads of one key have equal ones has a chance of
#: 2^-128 a comparison.
SEEDS = (11, 77)


def read_dictionary(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame | None:
    """(node_id, key columns, ordinal) of a dictionary, or None if there is none at path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    known = spark.read.parquet(path)
    if known.columns != ["node_id", *key, "ordinal"]:
        raise ValueError(f"{path}: a dictionary of {known.columns}, not of {['node_id', *key, 'ordinal']}")
    return known


def add_ordinals(keys: DataFrame, path: str) -> DataFrame:
    """The dictionary at path after what is new in keys (node_id and key columns, no row twice) has been added to it.

    Known keys keep their ordinals. New ones lie above the largest known, from a new word on, and follow each other
    within a task, so that words are full. One run at a time may add. They are appended in one commit; a task that is repeated before it may number
    anew, as nothing has been read of it. Null key columns are values like any other.
    """
    spark, names = keys.sparkSession, keys.columns
    known = read_dictionary(spark, path, names[1:])
    top = None if known is None else known.agg(F.max("ordinal")).first()[0]
    fresh = keys if known is None else null_safe(keys, known, names, "left_anti")
    base = 0 if top is None else (top // WORD + 1) * WORD
    fresh.withColumn("ordinal", F.monotonically_increasing_id() + F.lit(base)).write.mode("append").parquet(path)
    return spark.read.schema(T.StructType([*keys.schema.fields, T.StructField("ordinal", T.LongType())])).parquet(path)


def payload_hashes(value: Column, expiry: Column) -> list[Column]:
    """Two hashes of bytes and expiry, in which null is a value of its own."""
    return [F.xxhash64(F.lit(s), value.isNull(), value, expiry.isNull(), expiry) for s in SEEDS]


def payloads(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, a, b): the payload of every key of every snapshot, from rows (by, __a, __b) of its hashes.

    Rows are combined before the shuffle, so repeated rows of one key cost a task one row. Where a snapshot holds a key
    with several payloads, a and b stand for the set of them: those rows, and only those, are counted once per payload
    first, spread by payload, and combined by exclusive or.
    """
    each = placed.groupBy(*by).agg(F.min("__a").alias("a"), F.max("__a").alias("__a2"), F.min("__b").alias("b"), F.max("__b").alias("__b2"))
    known = materialize(each.select(*by, "a", "b", ((F.col("a") != F.col("__a2")) | (F.col("b") != F.col("__b2"))).alias("__several")), "payloads")
    several = known.where("__several").select(*by)
    if several.isEmpty():
        return known.drop("__several")
    once = null_safe(placed.groupBy(*by, "__a", "__b").agg(F.count(F.lit(1)).alias("__n")), small_table(several), by, "left_semi")
    sets = once.groupBy(*by).agg(F.bit_xor("__a").alias("a"), F.bit_xor("__b").alias("b"), F.count(F.lit(1)).alias("__n"))
    mixed = sets.select(*by, *[F.xxhash64("__n", c).alias(c) for c in ("a", "b")])
    return known.where("NOT __several").drop("__several").unionByName(mixed)


def words(held: DataFrame) -> DataFrame:
    """(node_id, word, seq, bits, vector) from (node_id, seq, ordinal, a, b): a snapshot's non-empty bitmap words, each
    with its ordinals' payloads (pos, a, b) in order of their bits."""
    placed = held.select("node_id", F.expr("shiftright(ordinal, 6)").alias("word"), "seq", F.expr(f"cast(ordinal & {WORD - 1} as int)").alias("pos"), "a", "b")
    vector = F.sort_array(F.collect_list(F.struct("pos", "a", "b")))
    return placed.repartition("node_id", "word").groupBy("node_id", "word", "seq").agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("bits"), vector.alias("vector"))


def changed_words(held: DataFrame) -> DataFrame:
    """(node_id, word, seq, added, removed, changed): words of bitmaps of what differs from the snapshot before.

    Each word meets the one before it of its node, which needs no further shuffle; a word whose keys all are gone in
    the next snapshot has a row there, too.
    """
    order = Window.partitionBy("node_id", "word").orderBy("seq")
    lagged = held.select("node_id", "word", "seq", "bits", "vector", *[F.lag(c).over(order).alias(f"p_{c}") for c in ("seq", "bits", "vector")], F.lead("seq").over(order).alias("n_seq"))
    none = F.lit(0).cast("bigint")
    follows = F.col("p_seq") == F.col("seq") - 1
    before = F.when(follows, F.col("p_bits")).otherwise(none)
    common = F.col("bits").bitwiseAND(before)
    bit = lambda pos: F.call_function("shiftleft", F.lit(1).cast("bigint"), pos)

    def differs(x: Column) -> Column:
        # A vector has a payload per bit: that of a bit lies behind those of the bits below it.
        y = F.get(F.col("p_vector"), F.bit_count(F.col("p_bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), x["pos"])))))
        return (F.col("common").bitwiseAND(bit(x["pos"])) != 0) & ((x["a"] != y["a"]) | (x["b"] != y["b"]))

    met = lagged.select("node_id", "word", "seq", "n_seq", "bits", "vector", "p_vector", "p_bits", before.alias("before"), common.alias("common"))
    moved = F.when(F.col("common") == 0, none).otherwise(F.aggregate(F.filter("vector", differs), none, lambda acc, x: acc.bitwiseOR(bit(x["pos"]))))
    row = lambda seq, added, removed, changed: F.struct(seq.alias("seq"), added.alias("added"), removed.alias("removed"), changed.alias("changed"))
    here = row(F.col("seq"), F.expr("bits & ~before"), F.expr("before & ~bits"), moved)
    gone = F.when(~F.coalesce(F.col("n_seq") == F.col("seq") + 1, F.lit(False)), row(F.col("seq") + 1, none, F.col("bits"), none))
    each = met.select("node_id", "word", F.explode(F.array_compact(F.array(here, gone))).alias("r")).select("node_id", "word", "r.*")
    return each.where((F.col("seq") > 0) & ((F.col("added") != 0) | (F.col("removed") != 0) | (F.col("changed") != 0)))


def consecutive_changes(rows: DataFrame, files: DataFrame, key: Sequence[str] = ("db", "key"), value: str = "value", expiry: str = "expiry_ms", dictionary: str | None = None) -> tuple[DataFrame, str]:
    """(node_id, snap_id, previous_snap_id, key columns, change_kind): what differs from the node's snapshot before; and
    the path of the dictionary.

    change_kind is added, removed, or changed (bytes of value or expiry differ; null equals null). snap_id is the later
    snapshot; a node's first gives no rows. Snapshots that don't count are passed over; one without any rows removes all
    keys of the one before. Repeated rows change nothing; a key that a snapshot holds with several payloads is changed
    if the set of its payloads differs. Null key columns are values like any other. Other columns are not read.

    dictionary is a folder that an earlier run gave or that shall be made; it outlives the session if the caller names
    it, else it lies in the shared folder until the session ends. A key column named node_id or ordinal is an error.
    """
    if {"node_id", "ordinal"} & set(key):
        raise ValueError("key columns can't be named node_id or ordinal")
    spark, path = rows.sparkSession, dictionary or fresh_path(rows.sparkSession, "ordinals")
    index = small_table(usable_snapshots(files).select("node_id", "snap_id", F.col("ord").alias("seq")))
    names = [f"__k{i}" for i in range(len(key))]
    a, b = payload_hashes(F.col(f"`{value}`").cast("binary"), F.col(f"`{expiry}`"))
    picked = rows.select(F.col("snap_id").alias("__snap"), *[F.col(f"`{c}`").alias(n) for c, n in zip(key, names)], a.alias("__a"), b.alias("__b"))
    placed = picked.join(index.select("node_id", F.col("snap_id").alias("__snap"), "seq"), "__snap").drop("__snap")
    held = payloads(placed, ["node_id", "seq", *names])
    known = add_ordinals(held.select("node_id", *[F.col(n).alias(c) for c, n in zip(key, names)]).distinct(), path)
    lookup = known.select(F.col("node_id").alias("__node"), *[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(key)], "ordinal")
    same = held["node_id"] == lookup["__node"]
    for i, n in enumerate(names):
        same = same & held[n].eqNullSafe(lookup[f"__d{i}"])
    # One row per key on the right, so a task's part of it is its share of the keys.
    numbered = held.join(lookup.hint("shuffle_hash"), same).select("node_id", "seq", "ordinal", "a", "b")
    found = changed_words(words(numbered))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("bits")) for k in ("added", "removed", "changed")])
    apart = found.select("node_id", "word", "seq", F.explode(F.filter(kinds, lambda x: x["bits"] != 0)).alias("k"))
    places = F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright(k.bits, i) & 1L) = 1L)")
    ordinals = apart.select(F.col("node_id").alias("__node"), "seq", "word", F.col("k.kind").alias("change_kind"), F.explode(places).alias("pos"))
    ordinals = ordinals.select("__node", "seq", "change_kind", (F.col("word") * WORD + F.col("pos")).alias("__ordinal"))
    # Only snapshots that exist: the one after a node's last has no row.
    here = index.select(F.col("node_id").alias("__node"), "seq", "snap_id")
    before = index.select(F.col("node_id").alias("__node"), (F.col("seq") + 1).alias("seq"), F.col("snap_id").alias("previous_snap_id"))
    dated = ordinals.join(here, ["__node", "seq"]).join(before, ["__node", "seq"])
    named = known.join(dated, (known["node_id"] == dated["__node"]) & (known["ordinal"] == dated["__ordinal"]))
    return named.select("node_id", "snap_id", "previous_snap_id", *[f"`{c}`" for c in key], "change_kind"), path

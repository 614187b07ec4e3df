"""Queries of problems 3, 4, 8, 9 and 10, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship, small_side, spread, utf8
from . import bpe, distinct, mixing, splitting, topn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(name: str) -> Column:
    return utf8(F.col(name)).alias(name)


def long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = topn.top_n(table(spark, sf_dir, "kv_zset"), 5, ["snap_id", "db", "key"], "member", "score")
    return top.select(long("snap_id"), long("db"), text("key"), "pos", text("member"), "score")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_top(spark, sf_dir).drop("score")


def dated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "snapshot_file").select("snap_id", F.date_format("taken_at", "yyyy-MM-dd").alias("snap_day"))
    rows = table(spark, sf_dir, "kv_string").select("snap_id", "db", "type", "key")
    return rows.join(small_side(days), "snap_id", "left")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.rows_per_value(dated_strings(spark, sf_dir), ["snap_day", "db", "type"], "key", 2.0).select("snap_day", long("db"), "type")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day, db, type and combination; level's bits mark what is all (day 4, db 2, type 1)."""
    groups = ["snap_day", "db", "type"]
    cube = distinct.merge_cube(distinct.sketches(dated_strings(spark, sf_dir), groups, "key"), groups)
    known = distinct.estimates(cube, [*groups, "level"])
    return known.select("snap_day", long("db"), "type", "level", "n_rows", F.round("estimate").cast("bigint").alias("n_keys"), F.floor("low").alias("low"), F.ceil("high").alias("high"))


def p4_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each count of p4_counts whether the true number of keys, counted exactly here, lies within its bounds."""
    groups = ["snap_day", "db", "type"]
    rows = dated_strings(spark, sf_dir)
    rows = rows.select("snap_day", long("db"), "type", "key")
    each = rows.groupBy(*groups, "key").agg(F.count(F.lit(1)).alias("__n"))
    exact = each.cube(*groups).agg(F.count_distinct("key").alias("n_keys"), F.grouping_id().alias("level")).select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("level").alias("__level"), F.col("n_keys").alias("__keys"))
    told = p4_counts(spark, sf_dir)
    same = F.col("level") == F.col("__level")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    both = told.join(exact, same, "full_outer")
    return both.select(*groups, "level", "n_rows", F.col("__keys").between(F.col("low"), F.col("high")).alias("within"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(long("doc_id"), bpe.token_ids(F.col("text")).alias("ids"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded from its ids, as a digest; a null text has no ids."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = docs.select(long("doc_id"), bpe.token_ids(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.md5(bpe.decoded(F.col("ids"))).alias("text_md5"), (F.size("ids") > 0).alias("has_ids"))


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, written once, as several steps read it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return materialize(docs.select("doc_id", "source", bpe.token_count(F.col("text")).alias("n_tokens")), "sizes")


def planned_mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    sizes = document_sizes(spark, sf_dir)
    leaves = mixing.read_leaves(sizes, table(spark, sf_dir, "mix_target"), ["source"])
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return sizes, mixing.plan(leaves, total)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose budget is all they have, and below their share."""
    _, planned = planned_mix(spark, sf_dir)
    return spark.createDataFrame([(p["leaf"].path[0],) for p in planned if p["short"]], "source string")


def p9_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, planned = planned_mix(spark, sf_dir)
    return mixing.draw(sizes, planned, ["source"]).select(long("doc_id"), "source", long("n_tokens"), long("times"))


def mixed(spark: SparkSession, sizes: DataFrame, planned: list[dict], path: list[str]) -> DataFrame:
    """Each leaf's share of weight, budget, and the tokens and share of tokens that the draw reaches."""
    rows = [(*p["leaf"].path, float(p["leaf"].weight), p["share"], int(p["leaf"].max_repeats), int(p["leaf"].tokens), int(p["budget"])) for p in planned]
    wanted = spark.createDataFrame(rows, ", ".join([*[f"`{c}` string" for c in path], "weight double, share double, max_repeats bigint, tokens bigint, budget bigint"]))
    drawn = materialize(mixing.draw(sizes, planned, path).groupBy(*path).agg(F.sum(F.col("n_tokens") * F.col("times")).alias("drawn"), F.max("times").alias("most_times")), "drawn")
    largest = sizes.groupBy(*path).agg(F.max("n_tokens").alias("largest"))
    total = drawn.agg(F.sum("drawn")).first()[0] or 0
    both = wanted.join(small_side(drawn), path, "left").join(largest, path, "left")
    got = F.coalesce("drawn", F.lit(0))
    return both.select(*path, "weight", "share", "max_repeats", "tokens", "budget", got.alias("drawn"), (got / F.lit(max(total, 1))).alias("reached"), F.coalesce("most_times", F.lit(0)).alias("most_times"), F.coalesce("largest", F.lit(0)).alias("largest"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, *planned_mix(spark, sf_dir), ["source"]).drop("weight", "largest")


def kept(mix: DataFrame, *more: str) -> DataFrame:
    """Whether each leaf's draw is within one text of its budget, and no text used too often."""
    near = (F.col("drawn") <= F.col("budget")) & ((F.col("budget") - F.col("drawn") < F.col("largest")) | (F.col("budget") == F.col("drawn")))
    return mix.select(*more, near.alias("within_one_text"), ((F.col("most_times") <= F.col("max_repeats")) & (F.col("budget") <= F.col("max_repeats") * F.col("tokens"))).alias("within_repeats"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(mixed(spark, *planned_mix(spark, sf_dir), ["source"]), "source")


TREE = ["domain", "lang", "source"]


def tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix over a tree: texts with a diff and messages alone, then languages, then sources. A source's weight of
    mix_target is shared equally by its leaves; languages of texts without one are `none`."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    domain = F.when(F.contains("text", F.lit("diff --git ")), "diff").otherwise("message")
    sizes = materialize(docs.select("doc_id", domain.alias("domain"), F.coalesce("lang", F.lit("none")).alias("lang"), "source", bpe.token_count(F.col("text")).alias("n_tokens")), "sizes")
    leaves = sizes.select(*TREE).distinct()
    targets = leaves.join(table(spark, sf_dir, "mix_target"), "source").withColumn("weight", F.col("weight") / F.count(F.lit(1)).over(Window.partitionBy("source")))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return mixed(spark, sizes, mixing.plan(mixing.read_leaves(sizes, targets, TREE), total), TREE)


def p9_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_mix(spark, sf_dir).drop("largest")


def p9_tree_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside p9_check's tests: whether at each level of the tree the nodes that aren't full have budgets in proportion to
    their weights, so that a full node's shortage went to its siblings in proportion and no further than they had room."""
    mix = tree_mix(spark, sf_dir)
    fair = F.lit(True)
    for depth in range(len(TREE)):
        node, parent = TREE[: depth + 1], TREE[:depth]
        total = lambda c: F.sum(c).over(Window.partitionBy(*node))  # noqa: E731, B023
        room, budget, weight, n = total(F.col("max_repeats") * F.col("tokens")), total("budget"), total("weight"), total(F.lit(1))
        mix = mix.withColumns({f"__n{depth}": n, f"__w{depth}": weight, f"__r{depth}": F.when(room - budget > n, budget / weight)})
        siblings = Window.partitionBy(*parent)
        ratio, spare = F.col(f"__r{depth}"), F.max(F.col(f"__n{depth}") / F.col(f"__w{depth}")).over(siblings)
        fair = fair & (F.coalesce(F.max(ratio).over(siblings) - F.min(ratio).over(siblings), F.lit(0.0)) <= 2 * spare)
    return kept(mix.withColumn("in_proportion", fair), *TREE, "in_proportion")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return pieces.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), texts=False)
    return pieces.where(F.col("piece_no") == 0).select(long("doc_id"))


def p10_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, put together again from its pieces less their overlaps, as a digest; a text within the limit is one
    piece. And whether all its pieces are within the limit and begin 128 tokens before the end of the one before."""
    order = Window.partitionBy("doc_id").orderBy("piece_no")
    steps = p10_pieces(spark, sf_dir).withColumns({"__end": F.coalesce(F.lag("end_byte").over(order), F.lit(0)), "__token": F.lag("end_token").over(order)})
    fresh = (F.col("end_byte") - F.col("__end")).cast("int")
    new = F.substr(F.encode("piece", "utf-8"), F.octet_length("piece") - fresh + 1, fresh)
    sound = (F.col("n_tokens") <= splitting.LIMIT) & F.coalesce(F.col("start_token") == F.col("__token") - splitting.OVERLAP, F.col("start_token") == 0)
    whole = steps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("b")))).alias("__p"), F.min(sound).alias("__sound"))
    built = whole.select(F.col("doc_id").alias("__doc"), F.md5(F.unhex(F.array_join(F.transform("__p", lambda x: F.hex(x["b"])), ""))).alias("__md5"), "__sound")
    docs = table(spark, sf_dir, "documents").select(long("doc_id"), "text")
    both = docs.join(built, F.col("doc_id") == F.col("__doc"), "left")
    return both.select("doc_id", F.coalesce("__md5", F.md5("text")).alias("text_md5"), F.coalesce("__sound", F.lit(True)).alias("sound"))


QUERIES = {f.__name__: f for f in (p3_found, p3_top, p4_found, p4_counts, p4_within, p8_ids, p8_roundtrip, p9_found, p9_draw, p9_mix, p9_check, p9_tree, p9_tree_check, p10_found, p10_pieces, p10_rebuilt)}

TOP = """
WITH best AS (SELECT snap_id, db, key, member, max(CASE WHEN score = 0 THEN 0.0 ELSE score END) AS score FROM kv_zset WHERE member IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY snap_id, db, key ORDER BY score DESC, member) AS pos FROM best)"""

SQL = {
    "p3_found": TOP + " SELECT snap_id, db, decode(key) AS key, pos, decode(member) AS member FROM ranked WHERE pos <= 5",
    "p3_top": TOP + " SELECT snap_id, db, decode(key) AS key, pos, decode(member) AS member, score FROM ranked WHERE pos <= 5",
    "p4_found": """
SELECT strftime(f.taken_at, '%Y-%m-%d') AS snap_day, s.db AS db, s.type AS type FROM kv_string s JOIN snapshot_file f USING (snap_id)
GROUP BY 1, 2, 3 HAVING count(*) >= 2 * count(DISTINCT s.key)""",
    "p4_within": """
WITH r AS (SELECT strftime(f.taken_at, '%Y-%m-%d') AS snap_day, s.db AS db, s.type AS type FROM kv_string s LEFT JOIN snapshot_file f USING (snap_id))
SELECT snap_day, db, type, CAST(grouping(snap_day, db, type) AS BIGINT) AS level, count(*) AS n_rows, true AS within FROM r GROUP BY CUBE (snap_day, db, type)""",
    "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(text, '') <> '' AS has_ids FROM documents",
    "p9_check": "SELECT source, true AS within_one_text, true AS within_repeats FROM mix_target",
    "p9_tree_check": """
SELECT DISTINCT CASE WHEN contains(d.text, 'diff --git ') THEN 'diff' ELSE 'message' END AS domain, coalesce(d.lang, 'none') AS lang, d.source AS source, true AS in_proportion, true AS within_one_text, true AS within_repeats
FROM documents d JOIN mix_target t ON t.source = d.source""",
    "p10_rebuilt": "SELECT doc_id, md5(text) AS text_md5, true AS sound FROM documents",
}

"""Attribute-value rows into one typed row per entity.

Each entity's resolved pairs are aggregated into a map from attribute to value; known attributes are then projected
from the map into typed columns, and values that fit no column's type stay in a map of cast failures.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import local_table, utf8

#: What outer blanks are, the placeholders that fit no column, and the spellings of booleans.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PLACEHOLDERS = ("", "null", "none", "nil", "n/a", "undefined", "-", "?")
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

INT_FORM = r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.0+)?$"
DOUBLE_FORM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ISO_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"

KINDS = {"int": "bigint", "double": "double", "bool": "boolean", "ts": "timestamp", "string": "string"}


def spelled(name: Column) -> Column:
    """A name without case and without all but letters and digits."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def fitted(text: Column, kind: str) -> Column:
    """text, already without outer blanks, as the type of kind; null where it doesn't fit."""
    if kind == "string":
        value = text
    elif kind == "int":
        value = F.when(text.rlike(INT_FORM), F.regexp_replace(text, r"\..*$|,", "").try_cast("bigint"))
    elif kind == "double":
        number = F.when(text.rlike(DOUBLE_FORM), text.try_cast("double"))
        value = F.when(F.abs(number) < F.lit(float("inf")), number)
    elif kind == "bool":
        low = F.lower(text)
        value = F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))
    elif kind == "ts":
        iso = F.replace(text, F.lit(","), F.lit("."))
        for found, whole in ((r"([T ][0-9]{2}:[0-9]{2})(Z|[+-]|$)", "$1:00$2"), (r"([T ].*[+-][0-9]{2})([0-9]{2})$", "$1:$2"), (r"([T ].*[+-][0-9]{2})$", "$1:00")):
            iso = F.regexp_replace(iso, found, whole)  # the parts that the cast asks for: seconds, colon, minutes of offset
        value = (
            F.when(text.rlike(r"^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("bigint")))
            .when(text.rlike(r"^[0-9]{13}$"), F.timestamp_millis(text.try_cast("bigint")))
            .when(text.rlike(ISO_FORM), iso.try_cast("timestamp"))
        )
    else:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    return F.when(~F.lower(text).isin(*PLACEHOLDERS), value)


def read_spec(spec: DataFrame, most: int = 5_000) -> list[tuple[str, str]]:
    """(attr, kind) of the wide table's columns. The columns are part of the plan, so their number is bounded.

    Rows without attr are passed over; of an attr given more than once the kind that comes first by name holds; an
    unknown or missing kind is an error.
    """
    rows = spec.select("attr", "kind").where(F.col("attr").isNotNull()).distinct().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} attributes can't be columns of one table")
    found: dict[str, str] = {}
    for r in rows:
        if r["kind"] not in KINDS:
            raise ValueError(f"attr {r['attr']!r} has unknown kind {r['kind']!r}")
        found[r["attr"]] = min(r["kind"], found.get(r["attr"], r["kind"]))
    return sorted(found.items())


def column_names(attrs: Sequence[str], entity: Sequence[str]) -> dict[str, str]:
    """The column of each attr: its own name, or attr_ before it where that name is taken."""
    taken = {c.lower() for c in entity} | {"cast_failures"}
    names = {}
    for a in attrs:
        name = a
        while name.lower() in taken:
            name = f"attr_{name}"
        taken.add(name.lower())
        names[a] = name
    return names


def wide_table(pairs: DataFrame, spec: Sequence[tuple[str, str]], entity: Sequence[str] = ("snap_id", "db", "key"), field: str = "field", value: str = "value") -> DataFrame:
    """One row per entity: its columns, one typed column per attr of spec, and cast_failures.

    - A field names the attr that it equals when case and all but letters and digits are disregarded; where two attrs
      are spelled alike, it names both. Other fields are stray and give no column.
    - Of several fit values of one attr the one of the lowest (field, value) bytes holds; if none is fit, the column is
      null and cast_failures has the first unfit text under the attr. A null value is neither fit nor a failure.
    - An entity with only stray fields or none at all (null field) still is a row. Null entity columns are values like
      any other. Repeated rows change nothing. An empty table gives an empty result.
    - Other columns of pairs, whatever their names, are not read.

    Pairs are reduced to one per (entity, attr) before the shuffle by entity, so an entity of very many rows costs each
    task at most one row per attr.
    """
    names = column_names([a for a, _ in spec], entity)
    keys = [F.col(f"`{c}`").alias(f"__e{i}") for i, c in enumerate(entity)]
    ids = [f"__e{i}" for i in range(len(entity))]
    rows = pairs.select(*keys, F.col(f"`{field}`").cast("binary").alias("__f"), F.col(f"`{value}`").cast("binary").alias("__v"))
    listed = pa.table({"__attr": pa.array([a for a, _ in spec], pa.string()), "__kind": pa.array([k for _, k in spec], pa.string())})
    known = local_table(pairs.sparkSession, listed, "__attr string, __kind string").withColumn("__s", spelled(F.col("__attr")))
    named = rows.withColumn("__s", spelled(utf8(F.col("__f")))).join(F.broadcast(known), "__s", "left")
    text = F.btrim(utf8(F.col("__v")), F.lit(BLANKS))
    fit = F.lit(False)
    for kind in sorted({k for _, k in spec}):
        fit = F.when(F.col("__kind") == kind, fitted(F.col("__t"), kind).isNotNull()).otherwise(fit)
    judged = named.select(*ids, "__attr", "__kind", "__f", F.when(F.col("__attr").isNotNull(), F.col("__v")).alias("__v"), F.when(F.col("__attr").isNotNull(), text).alias("__t"))
    judged = judged.select(*ids, "__attr", "__kind", F.when(F.col("__t").isNotNull(), F.struct((~fit).alias("unfit"), F.col("__f").alias("f"), F.col("__v").alias("v"), F.col("__t").alias("t"))).alias("__c"))
    resolved = judged.groupBy(*ids, "__attr", "__kind").agg(F.min("__c").alias("__c"))
    # One typed value per pair; the columns then only pick theirs from the map.
    cell = [F.when((F.col("__kind") == kind) & ~F.col("__c.unfit"), fitted(F.col("__c.t"), kind)).alias(kind) for kind in sorted({k for _, k in spec})]
    pair = F.when(F.col("__attr").isNotNull() & F.col("__c").isNotNull(), F.struct("__attr", F.struct(F.col("__c.unfit").alias("unfit"), F.col("__c.t").alias("t"), *cell)))
    mapped = resolved.groupBy(*ids).agg(F.map_from_entries(F.collect_list(pair)).alias("__m"))
    typed = [F.element_at("__m", F.lit(a))[k].alias(names[a]) for a, k in spec]
    failures = F.transform_values(F.map_filter("__m", lambda _, c: c["unfit"]), lambda _, c: c["t"])
    return mapped.select(*[F.col(i).alias(c) for i, c in zip(ids, entity)], *typed, failures.alias("cast_failures"))


def filled_cells(wide: DataFrame, spec: Sequence[tuple[str, str]], entity: Sequence[str] = ("snap_id", "db", "key")) -> DataFrame:
    """(entity columns, attr) of every column of the wide table that holds a value."""
    names = column_names([a for a, _ in spec], entity)
    cells = F.array(*[F.when(F.col(f"`{names[a]}`").isNotNull(), F.lit(a)) for a, _ in spec]) if spec else F.array().cast("array<string>")
    return wide.select(*[f"`{c}`" for c in entity], F.explode(F.array_compact(cells)).alias("attr"))

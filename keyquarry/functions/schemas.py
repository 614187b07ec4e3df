"""The entries that the snapshot source gives, and the nine tables made of them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import types as T

#: Logical types in their order; geo and hyperloglog are derived.
TYPES = ("string", "list", "set", "zset", "hash", "geo", "hyperloglog", "module", "stream")
HEURISTICS = ("geo",)

U64 = T.DecimalType(20, 0)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


FIELD = _struct(("field", T.BinaryType(), True), ("value", T.BinaryType(), True), ("expiry_ms", T.LongType(), True))
SCORED = _struct(("member", T.BinaryType(), True), ("score", T.DoubleType(), True))
MODULE_VALUE = _struct(("opcode", T.StringType(), True), ("int_value", U64, True), ("double_value", T.DoubleType(), True), ("string_value", T.BinaryType(), True))
MODULE = _struct(("name", T.StringType(), True), ("version", T.LongType(), True), ("values", T.ArrayType(MODULE_VALUE), True))
PAIR = _struct(("field", T.BinaryType(), True), ("value", T.BinaryType(), True))
LOG_ENTRY = _struct(("id", T.StringType(), True), ("fields", T.ArrayType(PAIR), True))
STREAM = _struct(("length", U64, True), ("last_id", T.StringType(), True), ("entries", T.ArrayType(LOG_ENTRY), True))

#: One row per key, or per chunk of a long key. seq is the order in the file.
ENTRIES = _struct(
    ("file", T.StringType(), True), ("seq", T.LongType(), True), ("db", T.LongType(), True), ("key", T.BinaryType(), True),
    ("type_code", T.ShortType(), True), ("type", T.StringType(), True), ("encoding", T.StringType(), True),
    ("expiry_ms", T.LongType(), True), ("lru_idle_secs", U64, True), ("lfu_frequency", T.ShortType(), True),
    ("total_elements", T.LongType(), True), ("element_offset", T.LongType(), True), ("str", T.BinaryType(), True),
    ("elems", T.ArrayType(T.BinaryType()), True), ("scored", T.ArrayType(SCORED), True), ("fields", T.ArrayType(FIELD), True),
    ("module", MODULE, True), ("stream", STREAM, True),
)

#: One row per file: header and metadata. skipped and crc_checked are known once the whole file has been read.
INFO = _struct(
    ("file", T.StringType(), True), ("magic", T.StringType(), True), ("version", T.IntegerType(), True), ("aux", T.MapType(T.StringType(), T.StringType()), True),
    ("server_version", T.StringType(), True), ("ctime", U64, True), ("used_mem", U64, True), ("repl_id", T.StringType(), True), ("repl_offset", T.LongType(), True),
    ("skipped_unknown", T.LongType(), True), ("crc_checked", T.BooleanType(), True),
)

COMMON = (
    ("db", T.LongType(), False), ("key", T.BinaryType(), False), ("type", T.StringType(), False), ("expiry_ms", T.LongType(), True),
    ("lru_idle_secs", U64, True), ("lfu_frequency", T.ShortType(), True), ("encoding", T.StringType(), False), ("num_elements", U64, False),
)

OWN = {
    "string": (("value", T.BinaryType(), False),),
    "list": (("index", U64, True), ("element", T.BinaryType(), True)),
    "set": (("member", T.BinaryType(), True),),
    "zset": (("member", T.BinaryType(), True), ("score", T.DoubleType(), True)),
    "hash": (("field", T.BinaryType(), True), ("field_value", T.BinaryType(), True), ("field_expiry_ms", T.LongType(), True)),
    "geo": (("member", T.BinaryType(), True), ("longitude", T.DoubleType(), True), ("latitude", T.DoubleType(), True), ("geohash_score", T.DoubleType(), True)),
    "hyperloglog": (("hll_encoding", T.StringType(), False), ("cached_cardinality", T.LongType(), False), ("raw_value", T.BinaryType(), False)),
    "module": (
        ("module_name", T.StringType(), False), ("module_version", T.LongType(), False), ("value_index", T.LongType(), False), ("opcode", T.StringType(), False),
        ("int_value", U64, True), ("double_value", T.DoubleType(), True), ("string_value", T.BinaryType(), True),
    ),
    "stream": (("stream_id", T.StringType(), True), ("field", T.BinaryType(), True), ("field_value", T.BinaryType(), True)),
}


def schema_for(name: str) -> T.StructType:
    """The table's columns: the eight common ones, then its own."""
    return _struct(*COMMON, *OWN[name])


def parse_types(text: str | None) -> set[str] | None:
    """Types from a comma list, in any case, with blanks; hll is hyperloglog. None for None."""
    if text is None:
        return None
    out = set()
    for part in text.split(","):
        name = part.strip().lower()
        name = {"hll": "hyperloglog"}.get(name, name)
        if name not in TYPES:
            raise ValueError(f"unknown type {part.strip()!r}; known: {', '.join(TYPES)}")
        out.add(name)
    return out


def parse_heuristics(text: str) -> frozenset[str]:
    """all, none, or a comma list of heuristics."""
    names = [p.strip().lower() for p in text.split(",")]
    if names == ["all"]:
        return frozenset(HEURISTICS)
    if names == ["none"]:
        return frozenset()
    for n in names:
        if n not in HEURISTICS:
            raise ValueError(f"unknown heuristic {n!r}; known: all, none, {', '.join(HEURISTICS)}")
    return frozenset(names)


def format_heuristics(names: frozenset[str]) -> str:
    return ",".join(h for h in HEURISTICS if h in names) or "none"


#: Columns of unsigned 32 bits in exports; Spark has no such type.
SMALL = {"db", "module_version", "value_index"}
#: How exports' Arrow types are called in a printed schema.
PRINTED = {pa.int64(): "Int64", pa.binary(): "Binary", pa.string(): "Utf8", pa.uint64(): "UInt64", pa.uint32(): "UInt32", pa.uint8(): "UInt8", pa.float64(): "Float64"}


def arrow_schema(name: str, metadata: dict[str, str] | None = None) -> pa.Schema:
    """The schema of a type's exported files and batches: Spark's columns with the unsigned types they stand for."""
    plain = {T.LongType: pa.int64(), T.BinaryType: pa.binary(), T.StringType: pa.string(), T.DecimalType: pa.uint64(), T.ShortType: pa.uint8(), T.DoubleType: pa.float64()}
    return pa.schema([pa.field(f.name, pa.uint32() if f.name in SMALL else plain[type(f.dataType)], f.nullable) for f in schema_for(name)], metadata)


def describe(names: list[str] | None = None, output: str = "text") -> str:
    """The schemas of some or all types' exports, as text or JSON."""
    tables = {n: [{"name": f.name, "type": PRINTED[f.type], "nullable": f.nullable} for f in arrow_schema(n)] for n in names or TYPES}
    if output == "json":
        return json.dumps(tables, indent=2)
    lines = []
    for n, fields in tables.items():
        lines += [f"{n}:", *(f"  {f['name']}: {f['type']}{' (nullable)' if f['nullable'] else ''}" for f in fields), ""]
    return "\n".join(lines)

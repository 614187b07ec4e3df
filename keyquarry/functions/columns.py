"""Pure column expressions: type detection, geohash decoding, sizes, globs. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hll(value: Column) -> Column:
    """A cardinality sketch: at least 16 bytes, HYLL, then encoding 0 or 1."""
    return (F.octet_length(value) >= 16) & F.hex(F.substring(value, 1, 5)).isin("48594C4C00", "48594C4C01")


def hll_encoding(value: Column) -> Column:
    byte = F.hex(F.substring(value, 5, 1))
    return F.when(byte == "00", "dense").when(byte == "01", "sparse").otherwise("unknown")


def hll_cached_cardinality(value: Column) -> Column:
    """The count kept in bytes 8 to 15, little-endian; -1 where the top bit marks it stale or the value is too short."""
    digits = F.hex(F.substring(value, 1, 16))
    number = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(15, 7, -1)])
    stale = F.substring(digits, 31, 1) >= "8"
    return F.when((F.octet_length(value) < 16) | stale, F.lit(-1)).otherwise(F.conv(number, 16, 10).cast("bigint"))


#: Masks that gather every second bit, and the covered degrees.
GATHER = ((0, 0x5555555555555555), (1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF))
LATITUDE, LONGITUDE = 85.05112878, 180.0
STEPS = 2.0**26


def valid_geohash(score: Column) -> Column:
    """Whether a score is a 52-bit position: whole, 0 or more, below 2^52. NaN and infinities aren't."""
    return (score >= 0) & (score < 2.0**52) & (score == F.floor(score).cast("double"))


def even_bits(bits: Column) -> Column:
    """Bits 0, 2, 4 and so on, moved together."""
    for shift, mask in GATHER:
        bits = (bits if shift == 0 else bits.bitwiseOR(F.shiftright(bits, shift))).bitwiseAND(F.lit(mask))
    return bits


def _middle(cell: Column, span: float) -> Column:
    low = F.lit(-span) + (cell / F.lit(STEPS)) * F.lit(2 * span)
    high = F.lit(-span) + ((cell + F.lit(1.0)) / F.lit(STEPS)) * F.lit(2 * span)
    return (low + high) / F.lit(2.0)


def geohash_longitude(score: Column) -> Column:
    bits = F.when(valid_geohash(score), score.cast("bigint"))
    return _middle(even_bits(F.shiftright(bits, 1)).cast("double"), LONGITUDE)


def geohash_latitude(score: Column) -> Column:
    bits = F.when(valid_geohash(score), score.cast("bigint"))
    return _middle(even_bits(bits).cast("double"), LATITUDE)


def is_geo() -> Column:
    """An entry whose scores are all positions: not empty and not a chunk of a longer sorted set."""
    return F.col("total_elements").isNull() & (F.size("scored") > 0) & F.forall("scored", lambda x: F.coalesce(valid_geohash(x["score"]), F.lit(False)))


def primary_type() -> Column:
    """The entry's type: hyperloglog for sketches in strings, else the type of its code; never geo."""
    return F.when((F.col("type") == "string") & is_hll(F.col("str")), "hyperloglog").otherwise(F.col("type"))


def is_first_chunk() -> Column:
    return F.coalesce("element_offset", F.lit(0)) == 0


def row_count() -> Column:
    """Rows that an entry has in the table of its type: one at least."""
    stream = F.aggregate("stream.entries", F.lit(0), lambda n, e: n + F.greatest(F.lit(1), F.size(e["fields"])))
    n = (
        F.when(F.col("elems").isNotNull(), F.size("elems"))
        .when(F.col("scored").isNotNull(), F.size("scored"))
        .when(F.col("fields").isNotNull(), F.size("fields"))
        .when(F.col("module").isNotNull(), F.size("module.values"))
        .when(F.col("stream").isNotNull(), stream)
        .otherwise(F.lit(1))
    )
    return F.greatest(F.lit(1), n).cast("bigint")


def estimated_bytes() -> Column:
    """Variable-length bytes of an entry's rows: its key on each row, and its payload; numbers of modules and scores count 8."""
    zero = F.lit(0).cast("bigint")
    size = lambda c: F.octet_length(c).cast("bigint")
    payload = (
        F.when(F.col("str").isNotNull(), size(F.col("str")))
        .when(F.col("elems").isNotNull(), F.aggregate("elems", zero, lambda n, x: n + size(x)))
        .when(F.col("scored").isNotNull(), F.aggregate("scored", zero, lambda n, x: n + size(x["member"]) + 8))
        .when(F.col("fields").isNotNull(), F.aggregate("fields", zero, lambda n, x: n + size(x["field"]) + size(x["value"])))
        .when(F.col("module").isNotNull(), F.aggregate("module.values", zero, lambda n, x: n + F.coalesce(size(x["string_value"]), F.lit(8))))
        .when(F.col("stream").isNotNull(), F.aggregate("stream.entries", zero, lambda n, e: n + F.aggregate(e["fields"], zero, lambda m, x: m + size(x["field"]) + size(x["value"]))))
        .otherwise(zero)
    )
    return size(F.col("key")) * row_count() + payload


def glob_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression, negated) of a glob.

    ? and * don't match /, ** as a whole path segment does; [a-z], [!a] and [^a]; {a,b}; a leading ! negates; \\ escapes.
    """
    negated = False
    while pattern.startswith("!"):
        negated, pattern = not negated, pattern[1:]
    out, i, depth, n = [], 0, 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            out.append(re.escape(pattern[i + 1]))
            i += 2
        elif c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            before, after = i == 0 or pattern[i - 1] == "/", j == n or pattern[j] == "/"
            if j - i >= 2 and before and after:
                if j < n:  # **/ stands for any number of segments, none too
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
            i = j
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            j = i + 1
            negate = j < n and pattern[j] in "!^"
            j += negate
            members, first = [], True
            while j < n and (pattern[j] != "]" or first):
                if pattern[j] == "\\" and j + 1 < n:
                    j += 1
                    members.append(re.escape(pattern[j]))
                else:
                    members.append(pattern[j] if pattern[j] == "-" else re.escape(pattern[j]))
                first = False
                j += 1
            if j >= n:
                out.append("(?!)")  # a class without end matches nothing
                break
            out.append(f"[{'^' if negate else ''}{''.join(members)}]")
            i = j + 1
        elif c == "{":
            out.append("(?:")
            depth += 1
            i += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        else:
            out.append(re.escape(c))
            i += 1
    out += [")"] * depth
    return f"(?s)^(?:{''.join(out)})\\z", negated


def key_matches(pattern: str) -> Column:
    """Whether the key, decoded with U+FFFD for bytes that aren't UTF-8, matches a glob."""
    expression, negated = glob_regex(pattern)
    hit = F.make_valid_utf8(F.col("key").cast("string")).rlike(expression)
    return ~hit if negated else hit

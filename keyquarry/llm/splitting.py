"""Cut texts of more tokens than a limit into overlapping pieces, at natural boundaries where possible.

Tokens' byte lengths give byte offsets as prefix sums; each boundary of the text (a new file, hunk or line of a commit)
is brought to a token offset in a sorted array. The last boundary under the limit is found by binary search, the next
piece steps back by the overlap, and where no boundary lies within reach the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteBpe, load, tokenizer_path

LIMIT, OVERLAP = 2048, 128
#: Where files, hunks and lines of a commit's text begin, in order of preference.
BOUNDARIES = (("file", rb"^diff --git "), ("hunk", rb"^@@ "), ("line", rb"(?<=\n)"))
#: Of the boundaries in reach one of a better kind is taken if the piece is at least so full with it; else the best kind
#: that fills the piece so far. More of it gives fuller pieces, less of it better boundaries.
FULL = 0.5
#: Bytes of pieces that one batch of rows holds, about.
BATCH_BYTES = 16 << 20

#: Before this blank a pre-token ends and with it a new one begins, whatever stands before and behind.
SEAM = re.compile(rb"(?<=[!-~])[ \t\n\x0b\x0c\r]")


def boundary_tokens(raw: bytes, offsets: np.ndarray, boundaries: Sequence[tuple[str, re.Pattern]]) -> list[tuple[str, np.ndarray]]:
    """Sorted token offsets of each kind of boundary. A boundary inside a token is moved to the token's beginning."""
    out = []
    for kind, pattern in boundaries:
        at = np.array([m.start() for m in pattern.finditer(raw)], dtype=np.int64)
        out.append((kind, np.unique(np.searchsorted(offsets, at, side="right") - 1)))
    return out


def _last(bounds: np.ndarray, low: int, high: int) -> int:
    """The last bound in (low, high], or -1."""
    i = int(np.searchsorted(bounds, high, side="right")) - 1
    return int(bounds[i]) if i >= 0 and bounds[i] > low else -1


def cut_points(raw: bytes, offsets: np.ndarray, limit: int, overlap: int, boundaries: Sequence[tuple[str, re.Pattern]], full: float = FULL, fits=None) -> list[tuple[int, int, str]]:
    """(first token, end token, kind of cut) of each piece; the last piece's kind is end.

    fits(start, end), if given, says by how many tokens the piece is too long when encoded by itself.
    """
    total = len(offsets) - 1
    bounds = boundary_tokens(raw, offsets, boundaries)
    pieces, start = [], 0
    while True:
        high, least = start + limit, start + overlap
        while True:
            if high >= total:
                end, kind = total, "end"
            else:
                end, kind = -1, ""
                for floor in (max(least, start + int(limit * full)), least):
                    for name, sorted_bounds in bounds:
                        if end < 0 and (at := _last(sorted_bounds, floor, high)) >= 0:
                            end, kind = at, name
                if end < 0:
                    end, kind = high, "hard"
                    while end > least + 1 and end > high - 4 and raw[offsets[end]] & 0xC0 == 0x80:  # not inside a character
                        end -= 1
            over = fits(start, end) if fits else 0
            if over <= 0 or end - over <= least:
                break
            high = min(high, end) - over
        pieces.append((start, end, kind))
        if end >= total:
            return pieces
        start = end - overlap


def own_length(bpe: ByteBpe, raw: bytes, offsets: np.ndarray, a: int, b: int) -> int:
    """Tokens of the piece from token a to b when it is encoded by itself.

    Between two seams the pre-tokens are those of the whole text; only what lies before the piece's first seam and
    behind its last one is encoded again. A piece without seams is encoded whole.
    """
    start, end = int(offsets[a]), int(offsets[b])
    count = lambda i, j: bpe.count(raw[i:j].decode("utf-8", "replace"))
    first = SEAM.search(raw, start + 1, end)
    if first is None:
        return count(start, end)
    low, high, reach = first.start(), first.start(), 64
    while low < end:  # the last seam lies near the end, mostly
        seams = [m.start() for m in SEAM.finditer(raw, max(low, end - reach), end)]
        if seams:
            high = seams[-1]
        if seams or end - reach <= low:
            break
        reach *= 8
    i, j = (int(np.searchsorted(offsets, x)) for x in (low, high))
    return count(start, low) + (j - i) + count(high, end)


def pieces_of(bpe: ByteBpe, raw: bytes, ids: np.ndarray, limit: int, overlap: int, boundaries: Sequence[tuple[str, re.Pattern]], full: float = FULL) -> list[tuple[int, int, int, int, int, str]]:
    """(piece_no, start_token, end_token, start_byte, end_byte, cut) of a text's pieces; none for one within the limit."""
    if len(ids) <= limit:
        return []
    offsets = np.concatenate([[0], np.cumsum(bpe.sizes[ids])])
    over = lambda a, b: own_length(bpe, raw, offsets, a, b) - limit
    return [(i, a, b, int(offsets[a]), int(offsets[b]), kind) for i, (a, b, kind) in enumerate(cut_points(raw, offsets, limit, overlap, boundaries, full, over))]


def split_oversized(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None, boundaries: Sequence[tuple[str, bytes]] = BOUNDARIES, full: float = FULL, texts: bool = True) -> DataFrame:
    """(key, piece_no, start_token, end_token, n_tokens, start_byte, end_byte, cut, piece) of texts over limit tokens.

    Each piece has at most limit tokens of the text's encoding, also when it is encoded by itself (unless its overlap
    leaves no room for that), and each after the first begins with the last overlap tokens of the one before. cut tells
    what the piece's end is: a kind of boundaries, hard (no boundary in reach) or end (of the text). boundaries are kinds
    and patterns of bytes, the better kinds first; full see FULL. piece is the text of the bytes; where the overlap
    begins inside a character, U+FFFD stands for its rest. Without texts there is no column piece. Null, empty and short
    texts give no rows; repeated keys are cut each; other columns are not read.

    Work and memory grow with a text's length: it is encoded once, each piece is a slice of its bytes, and rows go on in
    batches of about BATCH_BYTES.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    file, known = path or tokenizer_path(), [(kind, re.compile(pattern, re.M)) for kind, pattern in boundaries]
    picked = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    whole = [("piece_no", T.LongType()), ("start_token", T.LongType()), ("end_token", T.LongType()), ("start_byte", T.LongType()), ("end_byte", T.LongType()), ("cut", T.StringType())]
    if texts:
        whole.append(("piece", T.StringType()))
    schema = T.StructType([T.StructField("__key", picked.schema["__key"].dataType), *[T.StructField(n, t) for n, t in whole]])
    names = [n for n, _ in whole]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in batches:
            keys, rows, taken, size = batch.column(0), [], [], 0

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows)) or [()] * len(names)
                types = [pa.string() if n in ("cut", "piece") else pa.int64() for n in names]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(taken, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], ["__key", *names])

            for at, (t, ids) in enumerate(bpe.encoded(batch.column(1))):
                if len(ids) <= limit:
                    continue
                raw = t.encode()
                for p in pieces_of(bpe, raw, ids, limit, overlap, known, full):
                    rows.append((*p, raw[p[3] : p[4]].decode("utf-8", "replace")) if texts else p)
                    taken.append(at)
                    size += p[4] - p[3] if texts else 64
                    if size >= BATCH_BYTES:
                        yield out()
                        rows, taken, size = [], [], 0
            yield out()

    each = picked.mapInArrow(cut, schema)
    rest = ["start_byte", "end_byte", "cut", *(["piece"] if texts else [])]
    return each.select(F.col("__key").alias(key), "piece_no", "start_token", "end_token", (F.col("end_token") - F.col("start_token")).alias("n_tokens"), *rest)

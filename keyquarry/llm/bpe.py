"""Encoding of whole texts by a public byte-level BPE vocabulary.

The rank file is serialised directly as a sentencepiece BPE model: each byte string becomes a piece of byte-mapped
characters, scored by its negative rank, with identity normalisation. Merging the pair of best score is then merging the
pair of lowest rank. Texts are cut into the tokenizer's pre-tokens, each encoded by the model; decoding maps ids back to
byte strings.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pre-token pattern that belongs to the vocabulary, and the characters its \s stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts' parts of up to so many characters are remembered, so many at most; then the memory starts anew.
PART_CHARS, PARTS = 48, 400_000
#: Characters of texts that are looked at together, so that what is new in them goes to the model in one call.
GROUP_CHARS = 1 << 20


def tokenizer_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """Where a vocabulary file is: in folder, else in the public_tokenizers package, else in /opt/tokenizers."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings in order of rank."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks aren't 0 to {len(pairs) - 1}")
    return [t for _, t in pairs]


def byte_characters() -> dict[int, str]:
    """A visible character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialize_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; one more piece stands for unknown characters."""
    chars = byte_characters()
    # The message's field numbers (pieces 1, trainer 2, normalizer 3) and enum values (BPE 2, unknown 2).
    pieces = [(("".join(chars[b] for b in t)), -float(rank), 1) for rank, t in enumerate(tokens)]
    pieces.append(("<unk>", 0.0, 2))
    out = [_message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])) for text, score, kind in pieces]
    trainer = b"\x18\x02"
    plain = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"  # no dummy prefix, no blank removal, no blank escape
    return b"".join(out) + _message(2, trainer) + _message(3, plain)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(self.tokens))
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self._chars = byte_characters()
        self._pretokens = regex.compile(PATTERN)
        # A blank after a non-blank always begins a pre-token, so parts of blanks and what follows are encoded apart.
        self._parts = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self._known: dict[str, bytes] = {}  # ids of parts, as bytes
        self._pieces: dict[str, bytes] = {}  # ids of pre-tokens

    def _learn(self, parts: set[str]) -> None:
        """Encode parts that aren't known; the model sees each new pre-token once."""
        if len(self._known) + len(parts) > PARTS:
            self._known.clear()
            self._pieces.clear()
        cut = {p: self._pretokens.findall(p) for p in parts}
        new = [p for p in {p for pre in cut.values() for p in pre} if p not in self._pieces]
        if new:
            mapped = [p.encode().decode("latin-1").translate(self._chars) for p in new]
            for p, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                self._pieces[p] = struct.pack(f"<{len(ids)}i", *ids)
        pieces = self._pieces
        for p, pre in cut.items():
            self._known[p] = b"".join([pieces[x] for x in pre])

    def _parted(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """For each text the ids of its parts."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP_CHARS:
                group.append(self._parts.findall(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            known = self._known
            missing = {p for parts in group for p in parts if p not in known}
            if missing:
                if len(known) + len(missing) > PARTS:  # the memory starts anew: all parts of the group are needed
                    missing = {p for parts in group for p in parts}
                self._learn(missing)
            for parts in group:
                yield [known[p] for p in parts]
            for p in missing:
                if len(p) > PART_CHARS:
                    del known[p]

    def encoded(self, texts: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
        """Each text with its token ids; few of them are held at a time."""
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < GROUP_CHARS:
                some.append(texts[at].as_py())
                size += len(some[-1] or "")
                at += 1
            yield from zip(some, self.encode_all(some))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of whole texts; none for an empty or null text."""
        return [np.frombuffer(b"".join(ids), dtype="<i4") for ids in self._parted(texts)]

    def count_all(self, texts: list[str | None]) -> list[int]:
        return [sum(map(len, ids)) >> 2 for ids in self._parted(texts)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(self.tokens[i] for i in ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, kept for as long as the Python worker lives."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def token_ids(text: Column, path: str | None = None) -> Column:
    """Token ids of a text column, without special tokens; an empty array for empty and null texts."""
    file = path or tokenizer_path()

    @F.arrow_udf("array<bigint>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe = load(file)
        each = bpe.encode_all(texts.to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
        values = np.concatenate([np.zeros(0, dtype="<i4"), *each]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of token ids of a text column; 0 for empty and null texts."""
    file = path or tokenizer_path()

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        bpe = load(file)
        return pa.array(bpe.count_all(texts.to_pylist()), pa.int64())

    return count(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of an array of token ids, the inverse of token_ids; null for null."""
    file = path or tokenizer_path()

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        bpe = load(file)
        return pa.array([None if x is None else bpe.decode(x) for x in lists.to_pylist()], pa.string())

    return text(ids)

"""Byte-level BPE encoding and decoding through a hand-serialised sentencepiece model.

A rank file (token bytes in base64, rank) becomes a sentencepiece BPE model
without any training: every byte is mapped to one character, every token is a
piece of such characters whose score is its negative rank, and normalisation
is the identity.  Merging the best scored adjacent pair, leftmost first, is
then merging the lowest rank.  Texts are cut by the pattern of the rank file's
publisher; each match is encoded separately (a match that is itself a token is
that token), and ids are decoded by the inverse mapping.

With patterns for which a single blank between two characters that aren't
white space is always the beginning of a match (blank_begins), texts are cut
there first.  The ids of recently seen pieces are kept in a bounded table.

Cases: null text counts as empty and has no ids; special tokens in a text are
ordinary text; texts of any length are encoded whole; repeated rows give
repeated results; an empty table gives an empty result.  Only doc_id and text
are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import slices

#: The character of byte 0; the others follow.
FIRST_CHAR = 0x100
#: Pieces whose ids are kept at once, and the longest that is kept, in characters.
KEPT, LONGEST = 400_000, 64
_TO_CHARS = {b: FIRST_CHAR + b for b in range(256)}
_NOT_SINGLE = re.compile(r"\s | \s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """A protocol buffer field: int as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary; a piece's id is its rank, the unknown piece comes last."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = b"".join(_field(1, _field(1, chars(t).encode()) + _field(2, float(-r)) + _field(3, 1)) for r, t in enumerate(order))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(order)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, b"<unk>")
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encodes and decodes with a serialised model; made on each executor from its bytes."""

    def __init__(self, model: bytes, pattern: str, blank_begins: bool = False):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size() - 1
        self.pieces = [bytes(ord(c) - FIRST_CHAR for c in self.sp.id_to_piece(i)) for i in range(n)]
        self.ranks = {t: i for i, t in enumerate(self.pieces)}
        compiled = regex.compile(pattern)
        self.find = lambda text: [m.group() for m in compiled.finditer(text)] if compiled.groups else compiled.findall(text)
        self.blank_begins = blank_begins
        self.kept: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if not self.blank_begins or _NOT_SINGLE.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _learn(self, parts: set[str]) -> None:
        """Encode parts that aren't kept; matches that aren't tokens go through one call."""
        matches = [self.find(p) if self.blank_begins and not (p.isalpha() or p[0] == " " and p[1:].isalpha()) else [p] for p in parts]
        one = {m: self.ranks.get(m.encode()) for m in chain.from_iterable(matches)}
        new = [m for m, r in one.items() if r is None]
        made = dict(zip(new, map(_packed, self.sp.encode([chars(m.encode()) for m in new], num_threads=1)))) if new else {}
        made.update((m, _packed([r])) for m, r in one.items() if r is not None)
        ids = made.__getitem__
        self.kept.update((p, ids(own[0]) if len(own) == 1 else b"".join(map(ids, own))) for p, own in zip(parts, matches))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [self._cut(t) if t else [] for t in texts]
        parts = set(chain.from_iterable(cut))
        missing = parts.difference(self.kept)
        if missing and len(self.kept) + len(missing) > KEPT:
            self.kept = {p: self.kept[p] for p in parts - missing}
        if missing:
            self._learn(missing)
        kept = self.kept.__getitem__
        out = [b"".join(map(kept, c)) for c in cut]
        for p in missing:
            if len(p) > LONGEST:
                del self.kept[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_made: dict[str, ByteBPE] = {}


def made(model: bytes, pattern: str, blank_begins: bool = False) -> ByteBPE:
    """One encoder for each Python process and model."""
    key = f"{hashlib.sha256(model + pattern.encode()).hexdigest()}{blank_begins}"
    if key not in _made:
        _made[key] = ByteBPE(model, pattern, blank_begins)
    return _made[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, blank_begins: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256 and round_trip of every row."""
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    def run(batches):
        bpe = made(model.value, pattern, blank_begins)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = bpe.encode(texts)
                decoded = [bpe.decode(x) for x in ids]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                cols = [part.column("doc_id"), pa.array(n)]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (ids, decoded)]
                cols.append(pa.array([t.encode() == d for t, d in zip(texts, decoded)]))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

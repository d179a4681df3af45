"""Vectorised text kernels over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole column at once.  A word is
a maximal run of digits, letters a-z (after lower-casing A-Z) and bytes of
non-ASCII characters; a word never crosses a row border.  Null counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by the vectorised kernels.
SLICE_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = True
WORD[97:123] = True
WORD[128:] = True
LOWER_TABLE = LOWER.tobytes()
#: Lower-cases A-Z and turns every byte outside words into a blank.
WORD_TABLE = bytes(b if WORD[b] else 32 for b in LOWER_TABLE)

_MASK = (1 << 64) - 1


def gear(seed: int) -> np.ndarray:
    """A fixed table of 256 random 64-bit values."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of arbitrary substrings from one prefix sum, modulo 2**64."""

    def __init__(self, seed: int):
        self.gear = gear(seed)
        self.base = int(np.random.default_rng(seed + 1).integers(1 << 60, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            for name, b in (("_powers", self.base), ("_inverses", self.inverse)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.gear[data] * self._powers[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(prefix))
        return (prefix[ends] - prefix[starts]) * self._inverses[starts]


WORD_HASH = RollingHash(20240)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and the offsets of the rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES):
    """Parts of the batch with at most max_bytes of text each, or one row."""
    _, off = column_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_spans(lower: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row border the number of words before it."""
    n = len(lower)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = WORD[lower]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    before[off] = False  # a row begins here
    after = np.empty(n + 1, bool)
    after[n] = False
    after[:n] = inside
    after[off] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the column, and the offsets of the rows in them."""
    buf, off = column_bytes(col)
    lower = LOWER[buf]
    starts, ends, word_off = word_spans(lower, off)
    return mix(WORD_HASH.spans(WORD_HASH.prefix(lower), starts, ends)), word_off


def hash_word(word: bytes) -> int:
    """What word_hashes gives for this one word."""
    data = np.frombuffer(word, np.uint8)
    p = WORD_HASH.prefix(data)
    return int(mix(WORD_HASH.spans(p, np.zeros(1, np.int64), np.array([len(data)])))[0])


def rows_of(off: np.ndarray) -> np.ndarray:
    """For each element the row it belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))

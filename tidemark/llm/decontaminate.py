"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and split into words; a window is 10 consecutive
words of a benchmark item (an item of fewer words, but not none, is one
window).  Documents and windows are written as bytes, words between single
blanks, so a window occurs in a document exactly where its bytes do.

The search is Wu and Manber's: m is the length of the shortest pattern of a
set, a shift table over hashed blocks of B bytes says how far the end of a
window may jump when the block there occurs late or never in the first m bytes
of any pattern, a block whose shift is 0 selects a bucket of patterns by the
hash of their suffix block, and a direct comparison of all bytes confirms an
occurrence.  Many places of a batch are scanned side by side: the text is cut
in lanes which all take their jumps in the same vectorised step.  Patterns of
very different length are searched as separate sets, so that a few short ones
do not make all jumps short.

The items are a stated query set: they are read in blocks of BLOCK windows,
and every block is broadcast and searched against all documents.  With one
block documents never move; with more, one block at a time is held and broadcast, each
has a pass of its own, and the passes' findings meet the documents in a join.

Cases: null or empty texts have no words, n_words 0 and no hit; items without
words have no windows; a null item_id marks hits but is not listed; item ids
that repeat count once; repeated rows give repeated results; an empty
benchmark or documents table gives no hits or no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, merge_dealt, scratch
from .textbatch import LOWER, LOWER_TABLE, WORD_TABLE, column_bytes, gear, mix, slices, word_hashes, word_spans

WINDOW = 10
#: Windows of a block: about 100 MB with their tables.
BLOCK = 250_000
#: The patterns of a block are searched in sets, by length in bytes.
LENGTHS = (8, 32, 1 << 62)
LANE = 512
_TABLE_BITS = 18
_GEAR = gear(11)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split()


def item_windows(text: str | None, window: int = WINDOW) -> set[bytes]:
    """The windows of an item as byte patterns."""
    w = words(text)
    return {b" " + b" ".join(w[i : i + window]) + b" " for i in range(max(1, len(w) - window + 1))} if w else set()


class WuManber:
    """A set of byte patterns with its shift table, suffix buckets and the search."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = sorted(patterns)
        self.m = min(map(len, self.patterns))
        self.block = min(self.m, 8)
        head = np.frombuffer(b"".join(p[: self.m] for p in self.patterns), np.uint8).reshape(len(self.patterns), self.m)
        places = self.m - self.block + 1
        self.shift = np.full(1 << _TABLE_BITS, places, np.int64)
        for j in range(places):  # a later place gives a shorter jump and overwrites
            self.shift[self._hash(head, j)] = places - 1 - j
        suffix = self._hash(head, places - 1)
        order = np.argsort(suffix, kind="stable")
        self.bucket = order  # patterns by the hash of their suffix block
        self.first = np.searchsorted(suffix[order], np.arange((1 << _TABLE_BITS) + 1))
        self.prefix = self._hash(head, 0)

    def _hash(self, rows: np.ndarray, j: int) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(self.block):
            h = h * np.uint64(0x9E3779B97F4A7C15) + _GEAR[rows[:, j + k]]
        return (mix(h) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _hash_at(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.block):
            h = h * np.uint64(0x9E3779B97F4A7C15) + _GEAR[text[at + k]]
        return (mix(h) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences in data."""
        text, places = np.frombuffer(data, np.uint8), self.m - self.block
        last = len(text) - self.m  # the last place where a pattern can start
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, last + 1, LANE)
        end = np.minimum(at + LANE, last + 1)
        found_at, found_hash = [], []
        while len(at):
            h = self._hash_at(text, at + places)
            jump = self.shift[h]
            hit = jump == 0
            if hit.any():
                found_at.append(at[hit])
                found_hash.append(h[hit])
            at = at + np.maximum(jump, 1)
            more = at < end
            at, end = at[more], end[more]
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, h = np.concatenate(found_at), np.concatenate(found_hash)
        n = self.first[h + 1] - self.first[h]
        row = np.repeat(np.arange(len(at)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, pattern = at[row], self.bucket[self.first[h][row] + within]
        near = self._hash_at(text, start) == self.prefix[pattern]
        start, pattern = start[near], pattern[near]
        same = np.fromiter((data.startswith(self.patterns[p], s) for s, p in zip(start.tolist(), pattern.tolist())), bool, len(start))
        return start[same], pattern[same]


class Block:
    """The windows of some items: searchers by length, and the items of each window."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.searchers, self.items, self.n_words = [], [], []
        for low, high in zip((0, *LENGTHS), LENGTHS):
            if own := [w for w in windows if low <= len(w) < high]:
                s = WuManber(own)
                self.searchers.append(s)
                self.items.append([sorted(windows[p]) for p in s.patterns])
                self.n_words.append(np.array([p.count(b" ") - 1 for p in s.patterns]))


def normalised(col: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All rows as bytes, words between single blanks and rows between line ends; places of the blanks before words; offsets of rows in the words."""
    buf, off = column_bytes(col)
    lower = LOWER[buf]
    starts, ends, word_off = word_spans(lower, off)
    per_row = np.diff(word_off)
    size = ends - starts
    # row r: its words, each with a blank before it, then a blank and a line end
    out_len = np.bincount(np.repeat(np.arange(len(per_row)), per_row), size + 1, len(per_row)).astype(np.int64) + 2
    row_at = np.cumsum(out_len) - out_len
    upto = np.cumsum(size + 1) - (size + 1)
    first = np.zeros(len(per_row), np.int64)
    has = per_row > 0
    first[has] = upto[word_off[:-1][has]]
    blank = upto + np.repeat(row_at - first, per_row)
    out = np.full(int(out_len.sum()), 32, np.uint8)
    out[row_at + out_len - 1] = 10
    inside = np.zeros(len(lower) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # adjacent words of two rows keep their sum
    source = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int32) > 0)
    out[np.repeat(blank + 1 - (np.cumsum(size) - size), size) + np.arange(len(source))] = lower[source]
    return out.tobytes(), blank, word_off


def search_rows(col: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """For all words whether they are hit, the rows' offsets in them, and for each row the items found."""
    data, blank, word_off = normalised(col)
    n = len(blank)
    change = np.zeros(n + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(word_off) - 1)]
    for searcher, owners, n_words in zip(block.searchers, block.items, block.n_words):
        start, pattern = searcher.search(data)
        if len(start):
            word = np.searchsorted(blank, start)
            np.add.at(change, word, 1)
            np.add.at(change, word + n_words[pattern], -1)
            row = np.searchsorted(word_off, word, side="right") - 1
            for r, p in set(zip(row.tolist(), pattern.tolist())):
                items[r].update(owners[p])
    return np.cumsum(change[:-1]) > 0, word_off, items


def _blocks(benchmark: DataFrame, window: int, size: int):
    """Blocks of windows, read one after the other."""
    windows: dict[bytes, set[str]] = {}
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        for w in item_windows(row.t, window):
            windows.setdefault(w, set()).update([] if row.i is None else [row.i])
        if len(windows) >= size:
            yield Block(windows)
            windows = {}
    if windows:
        yield Block(windows)


_ADDED = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "hits"]


def _runs(mask: np.ndarray, word_off: np.ndarray) -> list[list[list[int]]]:
    """For each row the runs of hit words as [first, after the last]."""
    upto = np.concatenate([[0], np.cumsum(mask)])
    out: list[list[list[int]]] = [[] for _ in range(len(word_off) - 1)]
    for k in np.flatnonzero(upto[word_off[1:]] > upto[word_off[:-1]]):
        edge = np.diff(np.concatenate([[0], mask[word_off[k] : word_off[k + 1]].astype(np.int8), [0]]))
        out[k] = [[int(a), int(b)] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return out


def _result(part: pa.RecordBatch, base: list[str], n_words: np.ndarray, items: list, runs: list) -> pa.RecordBatch:
    """The columns of base and _ADDED."""
    lists = [sorted(s) for s in items]
    n_hit = np.array([sum(b - a for a, b in r) for r in runs], np.int64)
    added = [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit),
        pa.array([len(x) for x in lists], pa.int64()),
        pa.array(lists, pa.list_(pa.string())),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()),
        pa.array(n_hit > 0),
        pa.array(runs, pa.list_(pa.list_(pa.int64()))),
    ]
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in base], *added], names=[*base, *_ADDED])


def _key():
    return F.md5(F.col("text").cast("binary")).alias("_k")


def _found(docs: DataFrame, shared) -> DataFrame:
    """_k (digest of the text), items and hits of the rows of docs in which a window of the broadcast block occurs."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                mask, word_off, items = search_rows(part.column("text"), shared.value)
                runs = _runs(mask, word_off)
                own = pa.array([k for k, r in enumerate(runs) if r], pa.int64())
                cols = [part.column("_k").take(own), pa.array([sorted(items[k]) for k in own.to_pylist()], pa.list_(pa.string())), pa.array([runs[k] for k in own.to_pylist()], pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(cols, names=["_k", "items", "hits"])

    return docs.select(_key(), "text").mapInArrow(run, "_k string, items array<string>, hits array<array<long>>")


def _merge_runs(runs: list[list[int]]) -> list[list[int]]:
    """Overlapping and adjacent runs as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _block_by_block(docs: DataFrame, blocks, base: list[str]) -> DataFrame:
    """One pass for each block, of which one at a time is held and broadcast; then the passes' findings meet their rows."""
    sc, parts = docs.sparkSession.sparkContext, []
    with scratch(docs.sparkSession) as put:
        for b in blocks:
            shared = sc.broadcast(b)
            parts.append(put(_found(docs, shared)))
            shared.destroy()
        every = functools.reduce(DataFrame.unionByName, parts)
        # equal texts have the same findings
        every = every.groupBy("_k").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"), F.flatten(F.collect_set("hits")).alias("_hits"))
        joined = merge_dealt(docs.select(*[F.col(f"`{c}`") for c in base], _key()), every, ["_k"], "left").drop("_k")

        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    n_words = np.diff(word_hashes(part.column("text"))[1])
                    yield _result(part, base, n_words, [x or [] for x in part.column("_items").to_pylist()], [_merge_runs(x or []) for x in part.column("_hits").to_pylist()])

        return cut(joined.mapInArrow(run, _schema(docs, base)))


def _schema(docs: DataFrame, base: list[str]) -> str:
    return ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in base), "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, hits array<array<long>>"])


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs with n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated and hits.

    hits lists the runs of hit words as [first, after the last].  Result
    columns replace columns of docs with the same name.  A benchmark of one
    block needs one pass over docs and no shuffle; a larger one a pass for each block.
    """
    base = [c for c in docs.columns if c not in _ADDED]
    blocks = _blocks(benchmark, window, block)
    first, second = next(blocks, Block({})), next(blocks, None)
    if second is not None:
        return _block_by_block(docs, itertools.chain([first, second], blocks), base)
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                mask, word_off, items = search_rows(part.column("text"), shared.value)
                yield _result(part, base, np.diff(word_off), items, _runs(mask, word_off))

    return docs.select(*[F.col(f"`{c}`") for c in base]).mapInArrow(run, _schema(docs, base))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window occurs, with the columns of docs."""
    # the input columns whose names the search would replace are kept aside
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")])).drop(names[docs.columns.index("text")])
    clean = occurrences(renamed, benchmark).where(~F.col("contaminated"))
    return clean.select(*[(F.col("text") if c == "text" else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])


ORACLE = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN list_aggregate(w, 'string_agg', ' ') ELSE list_aggregate(w[i:i+9], 'string_agg', ' ') END AS g, least(len(w), 10) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') END AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS g FROM d, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS u(i)
), occ AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM occ, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

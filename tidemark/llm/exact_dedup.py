"""Exact dedup with content-defined chunk recipes.

Texts are equal when they are identical after lower-casing A-Z.  Every text is
cut into content-defined chunks (a gear hash of the last 32 bytes picks the
borders), and a text becomes its recipe: the ordered list of its chunks'
identifiers.  Long documents never move as a whole: each distinct chunk moves
once from each task to the place where chunks with the same digest are
compared byte by byte.  Digests with more than one content get numbered
identifiers, and recipes that use them are rewritten, so that equal recipes
mean equal texts whatever the digest does.  After that only recipes are
grouped, with partial aggregation, and joined back.

Cases: null text counts as empty, and all empty texts are one group.  Of equal
texts the row with the largest doc_id stays; a null doc_id is less than any
other.  Of rows that repeat doc_id and text, one row stays in `deduplicate`
and all carry the same decision in `exact_groups`.  An empty table gives an
empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_key, merge_dealt
from .textbatch import LOWER, column_bytes, gear, slices

#: A border comes after every 2**CHUNK_BITS bytes on average, and after MAX_CHUNK at most.
CHUNK_BITS = 11
MAX_CHUNK = 1 << 14
_GEAR = gear(7).astype(np.uint32)


def chunk_borders(lower: np.ndarray, off: np.ndarray, bits: int = CHUNK_BITS, longest: int = MAX_CHUNK) -> list[list[int]]:
    """For each row its chunk borders, the row's own ends included; they depend on the row's bytes only."""
    n = len(lower)
    h = _GEAR[lower]
    for shift in (1, 2, 4, 8, 16):
        if n > shift:
            h[shift:] += h[:-shift].copy() << np.uint32(shift)
    cuts = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    first = np.searchsorted(cuts, off[:-1] + 32)  # the hash of the first 32 bytes also sees the row before
    last = np.searchsorted(cuts, off[1:])
    out = []
    for a, b, i, j in zip(off[:-1].tolist(), off[1:].tolist(), first.tolist(), last.tolist()):
        borders = [a]
        for c in [*cuts[i:j].tolist(), b]:
            while c - borders[-1] > longest:
                borders.append(borders[-1] + longest)
            if c > borders[-1]:
                borders.append(c)
        out.append(borders)
    return out


def digest(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def _chunked(batches, size: int):
    """For each slice its ids, the lower-cased bytes and the borders."""
    for batch in batches:
        for part in slices(batch):
            buf, off = column_bytes(part.column("text"))
            lower = LOWER[buf]
            yield part.column("doc_id"), lower.tobytes(), chunk_borders(lower, off)


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, n_bytes, text_sha256 and recipe (the chunks' digests, joined) of every row."""

    def run(batches):
        for ids, data, borders in _chunked(batches, digest_bytes):
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([b[-1] - b[0] for b in borders], pa.int64()),
                    pa.array([hashlib.sha256(data[b[0] : b[-1]]).hexdigest() for b in borders]),
                    pa.array([b"".join([digest(data[x:y], digest_bytes) for x, y in zip(b, b[1:])]) for b in borders], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "text_sha256", "recipe"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, text_sha256 string, recipe binary")


def colliding_chunks(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """digest, content, number of every chunk whose digest belongs to several contents; as good as always empty.

    Each task sends each distinct chunk once; rows of a digest then lie next
    to each other in a sorted partition and are compared while they stream by.
    """

    def send(batches):
        seen: set[bytes] = set()
        for _, data, borders in _chunked(batches, digest_bytes):
            rows = {}
            for b in borders:
                for x, y in zip(b, b[1:]):
                    chunk = data[x:y]
                    full = xxhash.xxh3_128_digest(chunk) + hashlib.blake2b(chunk, digest_size=16).digest()
                    if full not in seen:
                        seen.add(full)
                        rows[chunk] = digest(chunk, digest_bytes)
            if len(seen) > 1 << 20:  # sends some chunks again, with bounded memory
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows.values(), pa.binary()), pa.array(rows.keys(), pa.binary())], names=["digest", "content"])

    def compare(batches):
        at, first, more = None, None, {}
        for batch in batches:
            found = []
            for d, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d != at:
                    found += [(at, c, k) for c, k in more.items()]
                    at, first, more = d, content, {}
                elif content != first and content not in more:
                    more = more or {first: 0}
                    more[content] = len(more)
            if found:
                yield _table(found)
        if more:
            yield _table([(at, c, k) for c, k in more.items()])

    def _table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["digest", "content", "number"])

    sent = docs.select("doc_id", "text").mapInArrow(send, "digest binary, content binary")
    return sent.repartition("digest").sortWithinPartitions("digest").mapInArrow(compare, "digest binary, content binary, number long")


def _numbered(docs: DataFrame, collisions: DataFrame, digest_bytes: int) -> DataFrame:
    """doc key and patch (the numbers of its colliding chunks, by place) of documents that have such chunks."""

    def emit(batches):
        for ids, data, borders in _chunked(batches, digest_bytes):
            rows = [(i, hashlib.sha256(data[b[0] : b[-1]]).hexdigest(), k, digest(data[x:y], digest_bytes), data[x:y]) for i, b in zip(ids.to_pylist(), borders) for k, (x, y) in enumerate(zip(b, b[1:]))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], ids.type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["doc_id", "text_sha256", "place", "digest", "content"])

    chunks = docs.select("doc_id", "text").mapInArrow(emit, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_sha256 string, place long, digest binary, content binary")
    hit = chunks.join(collisions, ["digest", "content"]).groupBy(doc_key().alias("_doc"), "text_sha256")
    return hit.agg(F.to_json(F.sort_array(F.collect_set(F.struct("place", "number")))).alias("patch"))


def exact_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes and n_chunks of every row."""
    mine = recipes(docs, digest_bytes)
    collisions = cut(colliding_chunks(docs, digest_bytes))
    if not collisions.isEmpty():
        patches = _numbered(docs, collisions, digest_bytes)
        mine = mine.withColumn("_doc", doc_key()).join(patches, ["_doc", "text_sha256"], "left").drop("_doc")
    else:
        mine = mine.withColumn("patch", F.lit(None).cast("string"))
    mine = cut(mine.withColumn("patch", F.coalesce("patch", F.lit(""))))
    groups = mine.groupBy("recipe", "patch").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The join has one more key than the aggregation, so both sides are dealt anew and
    # the planner may split the rows of a group that holds a large share of all rows.
    key = F.xxhash64("recipe", "patch").alias("_h")
    out = mine.select("*", key).join(groups.select("*", key), ["_h", "recipe", "patch"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes", F.expr(f"cast(octet_length(recipe) div {digest_bytes} as long)").alias("n_chunks"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs; texts move once, to meet their decisions."""
    kept = exact_groups(docs).where("kept").select(doc_key().alias("_doc"), F.col("text_sha256").alias("_sha")).distinct()
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # rows that repeat id and text are reduced before they move, however many there are
    mine = docs.withColumn("_doc", doc_key()).withColumn("_sha", F.sha2(lower.cast("binary"), 256)).dropDuplicates(["_doc", "_sha"])
    return merge_dealt(mine, kept, ["_doc", "_sha"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""

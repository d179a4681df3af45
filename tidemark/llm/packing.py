"""Token-id output: best-fit-decreasing packing into fixed sequences.

Every text is encoded with the ranks of a public vocabulary.  Documents longer
than a sequence are cut into pieces of the sequence length and one rest, so no
token is lost; pieces and shorter documents are packed into sequences of
SEQUENCE tokens, longest first, each into the open sequence with the least
room that is enough.  A segment tree over room sizes finds that sequence in
logarithmic time.

Documents are dealt to blocks of about BLOCK_BYTES bytes of text by a hash of
doc_id and text, as many blocks as all texts need, and packed in the order of that hash.
So memory is bounded, tasks are independent, and the sequences and their
numbers depend on the rows only, not on files or partitions.  A
block that holds more (rows that repeat, very long texts) is packed in
parts of BLOCK tokens.  A row of the result is one sequence: ids (little-endian 32-bit
integers, filled with PAD), cumulative segment lengths, position ids that
begin anew with every segment, and the document and first token of every
segment.  `write_packed` writes the matrix in binary Parquet columns through
Spark, to any store that Spark can write.

Cases: null and empty texts have no tokens and are in no sequence; texts of
any length are packed whole; repeated rows are packed as often as they occur;
an empty table gives no sequence.  Only doc_id and text are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .textbatch import slices

SEQUENCE = 2048
PAD = 0xFFFFFFFF
#: Tokens packed together at most, but for one document.
BLOCK = 1 << 20
#: Bytes of text of a block, about.
BLOCK_BYTES = 1 << 21


class RoomTree:
    """A segment tree over room sizes 0 ... capacity: how many open sequences have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, need: int) -> int:
        """The least room >= need that an open sequence has, or -1."""
        k = need + self.leaves
        if self.count[k]:
            return need
        while k > 1:  # up to the first subtree on the right with an open sequence
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k *= 2
                    k += not self.count[k]
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The indices of the items of each sequence; items longer than capacity aren't allowed."""
    tree, open_, out = RoomTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room < 0:
            k, room = len(out), capacity
            out.append([])
        else:
            k = open_[room].pop()
            tree.add(room, -1)
        out[k].append(i)
        if left := room - lengths[i]:
            open_.setdefault(left, []).append(k)
            tree.add(left, 1)
    return out


def pieces(lengths: list[int], sequence: int) -> tuple[list[int], list[int], list[int]]:
    """Document, first token and length of every piece."""
    doc, first, size = [], [], []
    for d, n in enumerate(lengths):
        for a in range(0, n, sequence):
            doc.append(d)
            first.append(a)
            size.append(min(sequence, n - a))
    return doc, first, size


_encoders: dict = {}


def pack(docs: DataFrame, ranks_path: str, pattern: str, sequence: int = SEQUENCE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """sequence_id, n_tokens, n_segments, ids, cu_seqlens, position_ids, doc_ids and starts of every sequence."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    total = docs.where("text <> ''").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def run(batches):
        import tiktoken

        key = (ranks_path, pattern)
        if key not in _encoders:
            _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        encode = _encoders[key].encode_ordinary
        at, part, ids, held, size = None, 0, [], [], 0
        for batch in batches:
            for rows in slices(batch):
                for b, i, t in zip(rows.column("_b").to_pylist(), rows.column("doc_id"), rows.column("text").to_pylist()):
                    if held and (b != at or size >= block):
                        yield sequences(at, part, ids, held)
                        part = part + 1 if b == at else 0
                        ids, held, size = [], [], 0
                    part = part if b == at else 0
                    at = b
                    ids.append(i)
                    held.append(np.array(encode(t), np.uint32))
                    size += len(held[-1])
        if held:
            yield sequences(at, part, ids, held)

    kind = docs.schema["doc_id"].dataType

    def sequences(at: int, part: int, ids: list[pa.Scalar], held: list[np.ndarray]) -> pa.RecordBatch:
        own = pa.array(ids, ids[0].type)
        doc, first, size = pieces([len(x) for x in held], sequence)
        rows = []
        for members in best_fit_decreasing(size, sequence):
            flat = np.concatenate([held[doc[m]][first[m] : first[m] + size[m]] for m in members])
            bounds = np.concatenate([[0], np.cumsum([size[m] for m in members])]).astype(np.int32)
            positions = np.zeros(sequence, np.uint32)
            positions[: len(flat)] = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
            row = np.full(sequence, PAD, np.uint32)
            row[: len(flat)] = flat
            rows.append((len(flat), len(members), row.astype("<u4").tobytes(), bounds.tolist(), positions.astype("<u4").tobytes(), [doc[m] for m in members], [first[m] for m in members]))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        arrays[5] = pa.ListArray.from_arrays(arrays[5].offsets, own.take(arrays[5].values))
        # room for 2**26 blocks, and in each for 2**17 parts of 2**20 sequences
        numbers = [(at << 37) + (part << 20) + k for k in range(len(rows))]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *arrays], names=["sequence_id", "n_tokens", "n_segments", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"])

    schema = f"sequence_id long, n_tokens long, n_segments long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind.simpleString()}>, starts array<long>"
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    mine = docs.where("text <> ''").select("doc_id", "text", F.pmod(key, F.lit(blocks)).alias("_b"), key.alias("_k"))
    # a few blocks for each task, as many tasks as the texts need
    dealt = mine.repartition(min(-(-blocks // 4), 100_000), "_b").sortWithinPartitions("_b", "_k", "doc_id", "text")
    return dealt.select("doc_id", "text", "_b").mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the id matrix, cumulative segment lengths and position ids, a row for each sequence."""
    packed.select("sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts").write.option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, start and ids of every segment: the exact inverse of packing."""

    def run(batches):
        for batch in batches:
            doc, start, out = [], [], []
            for data, bounds, docs_, starts in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "starts"))):
                doc += docs_
                start += starts
                out += [data[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("doc_ids").type.value_type), pa.array(start, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"])

    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()
    return packed.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, f"doc_id {kind}, start long, ids binary")



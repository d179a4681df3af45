"""Suffix-array dedup: maximal repeats of at least LENGTH bytes, over a whole corpus.

Texts are UTF-8 bytes and repeats never cross texts.  A byte is removed if it
is covered by a string of LENGTH bytes that also starts anywhere else.  A
passage is a run of at least PASSAGE_WORDS words that is covered by strings of
PASSAGE bytes which also start anywhere else: passages are found too, and are
not removed.

A suffix array over every byte of a corpus would have to be dealt by content
and would move every text hundreds of times.  Here it is sparse: every window
of PASSAGE bytes has one anchor, the first place in it whose next 16 bytes have
the least hash among those that leave CORE bytes within the window.  Equal
windows have their anchor at the same offset, so a repeat can be found from
the anchors in it.  An anchor's context reaches PASSAGE - CORE bytes to the left and
LENGTH to the right: it holds every window of PASSAGE bytes around the anchor,
and each longer repeat from the first anchor in it.

  1. One row for each anchor: hash of its core (CORE bytes) and of its context.
     Cores that occur once are done.
  2. Contexts that occur several times as a whole are repeats already (leaves
     of the tree with several occurrences).  Contexts count as equal if the
     64-bit hashes of both core and context are.
  3. Of cores with several contexts, each distinct context is sent once, and an
     enhanced suffix array is built over the suffixes that begin at the
     anchors: sorted suffixes and the common prefixes of neighbours.  A scan
     with a stack yields the tree of common-prefix intervals; in each interval
     of depth d the members' left extensions are sorted and scanned in the same
     way, and every interval of left depth l whose l + d is long enough and whose
     members differ on both sides is a maximal repeat, with all its occurrences.
  4. Occurrences become spans of documents, merged document by document.

A core with more than LARGE contexts is never gathered: its windows are
halved by their anchor's offset, which lengthens the core that the windows of
a half have in common, until each group is small or its windows are equal.
Cores and contexts that hold a large share of all anchors are dealt in parts.

Cases: null text counts as empty; texts shorter than LENGTH keep all bytes;
rows that repeat doc_id and text are repeats of each other; very long texts are
scanned in blocks that overlap; an empty table gives an empty result.  Only
doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, doc_key, heavy, merge_dealt, merge_split, scratch
from .textbatch import WORD_TABLE, RollingHash, column_bytes, mix, slices

LENGTH = 400
#: Bytes of the strings that make up passages, and the least words of a passage.
PASSAGE, PASSAGE_WORDS = 256, 51
CORE = 64
#: Contexts of a core that one task gathers; the common prefixes have a bounded length, so the scan's work grows in proportion to them.
LARGE = 20_000
#: Rows that a task holds as Python objects at once, about.
ROWS = 4000
#: Bytes scanned at once.
BLOCK = 1 << 20
_GRAM = 16
_HASH, _CONTEXT = RollingHash(41), RollingHash(43)


def anchors(data: np.ndarray, off: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, core: int) -> np.ndarray:
    """The places of the anchors of all windows of `least` bytes that begin at first ... last of each row, in order."""
    n, width, gram = len(data), least - core + 1, min(_GRAM, core)
    has = last >= first
    if n < least or not has.any():
        return np.zeros(0, np.int64)
    prefix = _HASH.prefix(data)
    places = np.arange(n - gram + 1)
    order = mix(_HASH.spans(prefix, places, places + gram))
    packed = np.full((len(places) + width) // width * width + width, np.iinfo(np.uint64).max, np.uint64)
    packed[: len(places)] = (order & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    blocks = packed.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    fro = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, first[has], 1)
    np.add.at(valid, last[has] + 1, -1)
    window = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    anchor = (np.minimum(fro[window], upto[window + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return anchor[np.diff(anchor, prepend=-1) != 0]


def hashed(data: np.ndarray, off: np.ndarray, a: np.ndarray, core: int, left: int, right: int) -> tuple[np.ndarray, ...]:
    """Rows, reach to the left and right (within the row), hash of the core and of the context of the anchors."""
    row = np.searchsorted(off, a, side="right") - 1
    lo, hi = np.minimum(a - off[row], left), np.minimum(off[row + 1] - a, right)
    key = mix(_HASH.spans(_HASH.prefix(data), a, a + core))
    shape = (lo * (right + 1) + hi).astype(np.uint64)
    return row, lo, hi, key, mix(_CONTEXT.spans(_CONTEXT.prefix(data), a - lo, a + hi) ^ mix(shape + np.uint64(1)))


def _anchor_rows(docs: DataFrame, least: int, core: int, left: int, right: int) -> DataFrame:
    """_doc, _t, at (the anchor's place), lo and hi (the context's reach), key and f of every anchor."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=BLOCK):
                buf, off = column_bytes(part.column("text"))
                if part.num_rows == 1 and len(buf) > 2 * BLOCK:
                    before = -1  # a place that is an anchor in two blocks counts once
                    for s in range(0, len(buf) - least + 1, BLOCK):
                        base = max(0, s - left)
                        data = buf[base : s + BLOCK + least + right]
                        border = np.array([0, len(data)])
                        a = anchors(data, border, np.array([s - base]), np.array([min(s + BLOCK - 1, len(buf) - least) - base]), least, core)
                        a = a[a + base != before]
                        if len(a):
                            before = int(a[-1]) + base
                            yield table(part, base, data, border, a)
                else:
                    yield table(part, 0, buf, off, anchors(buf, off, off[:-1], off[1:] - least, least, core))

    def table(part, base, data, off, a) -> pa.RecordBatch:
        row, lo, hi, key, f = hashed(data, off, a, core, left, right)
        idx = pa.array(row)
        cols = [part.column("_doc").take(idx), part.column("_t").take(idx), pa.array(a - off[row] + base), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(f.view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["_doc", "_t", "at", "lo", "hi", "key", "f"])

    return _texts(docs).mapInArrow(run, "_doc string, _t long, at long, lo int, hi int, key long, f long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("_doc"), F.xxhash64("text").alias("_t"), "text")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """The common-prefix intervals (depth, first, last) of sorted strings with depth >= least.

    lcp[i] is the common prefix of strings i and i+1.  The stack holds open
    intervals of growing depth; a smaller common prefix closes those above it.
    """
    out, stack = [], [(least - 1, 0)]
    for i, d in enumerate([*lcp, least - 1]):
        d, left = max(d, least - 1), i
        while stack[-1][0] > d:
            depth, left = stack.pop()
            out.append((depth, left, i))
        if stack[-1][0] < d:
            stack.append((d, left))
    return out


def tree(contexts: list[bytes], offsets: list[int], weights: list[int], length: int = LENGTH, core: int = CORE):
    """The maximal repeats of contexts that are aligned at their anchors.

    Yields (left, right, members): the repeat spans [anchor - left, anchor +
    right) in every member.  Members are indices; a context that occurs
    several times (weight) is a repeat on its own.
    """
    n = len(contexts)
    right = [c[o:] for c, o in zip(contexts, offsets)]
    left = [c[:o][::-1] for c, o in zip(contexts, offsets)]
    for i in range(n):
        if weights[i] > 1:
            yield len(left[i]), len(right[i]), [i]
    order = sorted(range(n), key=right.__getitem__)
    left_rank = {i: k for k, i in enumerate(sorted(range(n), key=left.__getitem__))}
    lcp = [common(right[a], right[b]) for a, b in zip(order, order[1:])]
    for depth, first, last in intervals(lcp, core):
        members = sorted(order[first : last + 1], key=left_rank.__getitem__)
        child, k = {}, 0  # members of one child have a longer common prefix
        for p in range(first, last + 1):
            child[order[p]] = k
            if p < last and lcp[p] == depth:
                k += 1
        ll = [common(left[a], left[b]) for a, b in zip(members, members[1:])]
        for reach, i, j in intervals(ll, max(0, length - depth)):
            own = members[i : j + 1]
            if any(child[m] != child[own[0]] for m in own):  # else a longer repeat has them all
                yield reach, depth, own


class _RangeMin:
    """The least value of any range of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            x, k = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-k], x[k:]))
        self.log = np.zeros(len(values) + 2, np.int64)
        for k in range(2, len(self.log)):
            self.log[k] = self.log[k // 2] + 1

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[first:end]; no range is empty."""
        k = self.log[end - first]
        out = np.empty(len(first), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            x = self.levels[level]
            out[at] = np.minimum(x[first[at]], x[end[at] - (1 << level)])
        return out


#: Groups of so many contexts are covered interval by interval, larger ones with arrays.
FEW = 12


def cover(contexts: list[bytes], offsets: list[int], weights: list[int], lengths: tuple[int, ...], core: int = CORE, few: int = FEW) -> dict[tuple[int, int], tuple[int, int]]:
    """For each context and each number of a length: how far left and right of the anchor the union of its repeats of that length reaches.

    In an interval of depth d the members are put in the order of their left
    extensions; a member's repeats reach as far left as it agrees with one of its two
    neighbours.  Intervals whose repeats aren't maximal add nothing to the union.
    """
    out: dict[tuple[int, int], tuple[int, int]] = {}
    n = len(contexts)
    if n <= few:
        for reach, depth, members in tree(contexts, offsets, weights, min(lengths), core):
            for k, length in enumerate(lengths):
                if reach + depth >= length:
                    for m in members:
                        a, b = out.get((m, k), (0, 0))
                        out[m, k] = (max(a, reach), max(b, depth))
        return out
    right = [c[o:] for c, o in zip(contexts, offsets)]
    left = [c[:o][::-1] for c, o in zip(contexts, offsets)]
    order = sorted(range(n), key=right.__getitem__)
    by_left = np.array(sorted(range(n), key=left.__getitem__))
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    lcp = [common(right[a], right[b]) for a, b in zip(order, order[1:])]
    agree = _RangeMin(np.array([common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])], np.int64))
    ranks = rank[order]
    l, r = (np.full((len(lengths), n), -1, np.int64) for _ in range(2))  # by rank
    for w in np.flatnonzero(np.array(weights) > 1):  # several occurrences of the whole
        for k, length in enumerate(lengths):
            if len(contexts[w]) >= length:
                l[k, rank[w]], r[k, rank[w]] = offsets[w], len(right[w])
    for depth, first, last in intervals(lcp, core):
        members = np.sort(ranks[first : last + 1])
        near = agree(members[:-1], members[1:])
        reach = np.zeros(len(members), np.int64)
        reach[:-1] = near
        reach[1:] = np.maximum(reach[1:], near)
        for k, length in enumerate(lengths):
            own = reach + depth >= length
            at = members[own]
            l[k, at] = np.maximum(l[k, at], reach[own])
            r[k, at] = np.maximum(r[k, at], depth)
    for k in range(len(lengths)):
        for x in np.flatnonzero(r[k] >= 0):
            out[int(by_left[x]), k] = (int(l[k, x]), int(r[k, x]))
    return out


_CONTEXTS = "okey long, of long, key long, f long, c long, lo int, hi int, context binary"


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The context of each row of wanted: _doc, _t, at, lo, hi, key, f, c."""
    lists = wanted.groupBy("_doc", "_t").agg(F.collect_list(F.struct("key", "f", "c", "at", "lo", "hi")).alias("w"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=BLOCK):
                rows = []
                for text, own in zip(part.column("text"), part.column("w")):
                    data = (text.as_py() or "").encode()
                    for x in own:
                        key, f, c, at, lo, hi = (x[k].as_py() for k in ("key", "f", "c", "at", "lo", "hi"))
                        rows.append((key, f, key, f, c, lo, hi, data[at - lo : at + hi]))
                        if len(rows) >= ROWS:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return merge_dealt(_texts(docs), lists, ["_doc", "_t"]).select("text", "w").mapInArrow(run, _CONTEXTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
    cols = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["okey", "of", "key", "f", "c", "lo", "hi", "context"])


def _by_core(rows: DataFrame, done, schema: str) -> DataFrame:
    """What done(key, {f: (context, place of the anchor, c)}) makes of each group of rows."""

    def run(batches):
        at, found = None, {}
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("key", "f", "context", "lo", "c")]
            for key, f, context, lo, c in zip(*cols):
                if key != at:
                    if found:
                        out += done(at, found)
                    at, found = key, {}
                found[f] = (context, lo, c)
            if out:
                yield table(out)
        if found:
            yield table(done(at, found))

    def table(rows):
        cols = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]
    return rows.select("key", "f", "context", "lo", "c").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _scan(rows: DataFrame, lengths: tuple[int, ...], core: int) -> DataFrame:
    """Suffix arrays of all groups: key, f, which (number of the length), and the reach l, r of the union of repeats around the anchor."""

    def done(key: int, found: dict[int, tuple]) -> list[tuple]:
        fs = list(found)
        ctx, off, w = ([found[f][k] for f in fs] for k in (0, 1, 2))
        return [(key, fs[m], k, l, r) for (m, k), (l, r) in cover(ctx, off, w, lengths, core).items()]

    return _by_core(rows, done, "key long, f long, which int, l int, r int")


def _groups(rows: DataFrame, length: int, core: int) -> DataFrame:
    """A row for each member of each maximal repeat: key, f, its reach l, r, its name and n (occurrences)."""

    def done(key: int, found: dict[int, tuple]) -> list[tuple]:
        fs = list(found)
        ctx, off, w = ([found[f][k] for f in fs] for k in (0, 1, 2))
        out = []
        for l, r, members in tree(ctx, off, w, length, core):
            name = int.from_bytes(hashlib.blake2b(ctx[members[0]][off[members[0]] - l : off[members[0]] + r], digest_size=8).digest(), "little", signed=True)
            out += [(key, fs[m], l, r, name, sum(w[x] for x in members)) for m in members]
        return out

    return _by_core(rows, done, "key long, f long, l int, r int, repeat long, n long")


def _halve(rows: DataFrame, level: int, length: int, core: int) -> DataFrame:
    """The parts of rows in the cells of this level, with the hashes of their longer core and shorter context; lo and hi are the parts' reach."""
    width = length - core + 1
    cells = min(1 << level, width)
    edges = [width * k // cells for k in range(cells + 1)]

    def run(batches):
        for batch in batches:
            out = []
            for okey, of, key, f, c, lo, hi, ctx in zip(*(col.to_pylist() for col in batch.columns)):
                # a window holds the anchor at offset o: least 0 or what the context's end leaves, greatest lo
                for s, e in zip(edges, edges[1:]):
                    low, high = max(length - hi, s, 0), min(lo, e - 1)
                    if low <= high:  # the anchor's offsets s ... e-1 share [anchor - s, anchor - (e-1) + length)
                        shared, own = ctx[lo - s : lo - (e - 1) + length], ctx[lo - high : lo - low + length]
                        k2, f2 = (int.from_bytes(hashlib.blake2b(x, digest_size=8, person=b"%d %d" % (level, s)).digest(), "little", signed=True) for x in (shared, own + b"%d" % (high - low)))
                        out.append((okey, of, k2, f2, c, high, length - low, own))
                if len(out) >= ROWS:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return rows.select("okey", "of", "key", "f", "c", "lo", "hi", "context").mapInArrow(run, _CONTEXTS)


def _hot(rows: DataFrame, large: int) -> DataFrame:
    """The cores with more than `large` contexts."""
    return cut(rows.groupBy("key").agg(F.countDistinct("f").alias("nd")).where(F.col("nd") > large).select("key"))


def _covered(rows: DataFrame, put, lengths: tuple[int, ...], core: int, large: int) -> list[DataFrame]:
    """key, f, which, l, r of all contexts (rows) that have a repeat around their anchor."""
    hot = _hot(rows, large)
    if hot.isEmpty():
        return [put(_scan(rows, lengths, core))]
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    parts = heavy(sizes, ["key"])
    split = lambda how: merge_split(rows, hot, ["key"], parts, ["f"], how)
    out = [put(_scan(split("left_anti"), lengths, core))]
    first = put(split("left_semi").select("okey", "of", "key", "f", "c", "lo", "hi", "context"))
    for which, length in enumerate(lengths):
        left, level = first, 0
        while left is not None:
            level += 1
            part = put(_halve(left, level, length, core))
            contexts = part.groupBy("key", "f").agg(F.sum("c").alias("s"), F.first("context").alias("context"), F.first("lo").alias("lo"))
            hot = _hot(part, large)
            again = hot.isEmpty()
            small = contexts.withColumnRenamed("s", "c")
            small = small if again else merge_dealt(small, hot, ["key"], "left_anti")
            found = _scan(small, (length,), core).drop("which")
            owners = part.select("okey", "of", "key", "f", "lo", "hi")
            reach = merge_dealt(owners, found, ["key", "f"]).select("okey", "of", "l", "r")
            # what occurs several times as a whole in its half is covered there
            whole = merge_dealt(owners, contexts.where("s > 1").select("key", "f"), ["key", "f"]).select("okey", "of", F.col("lo").alias("l"), F.col("hi").alias("r"))
            out.append(put(reach.union(whole).select(F.col("okey").alias("key"), F.col("of").alias("f"), F.lit(which).alias("which"), "l", "r")))
            left = None if again else put(merge_dealt(part, hot, ["key"], "left_semi"))
    return out


def spans(docs: DataFrame, lengths: tuple[int, ...], core: int = CORE, large: int = LARGE) -> DataFrame:
    """_doc, _t, which (number of the length) and spans (merged starts and ends of covered strings, in order) of documents that have any."""
    with scratch(docs.sparkSession) as put:
        found = put(_anchor_rows(docs, min(lengths), core, min(lengths) - core, max(lengths)))
        keys = put(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f0"), F.max("f").alias("f1")).where("n > 1"))
        several = keys.select("key", (F.col("f0") != F.col("f1")).alias("several"))
        # of the anchors whose core occurs again, and only they move on
        found = put(merge_split(found, several, ["key"], heavy(keys, ["key"]), ["f", "_doc", "at"]))
        place = F.struct("_doc", "_t", "at", "lo", "hi")
        distinct = put(found.groupBy("key", "f").agg(F.count(F.lit(1)).alias("c"), F.max("several").alias("several"), F.min(place).alias("p")).select("key", "f", "c", "several", "p.*"))
        rows = put(_contexts(docs, distinct.where("several")).dropDuplicates(["key", "f"]))
        parts = _covered(rows, put, lengths, core, large)
        # contexts that occur several times are covered as a whole, by every length that they have
        numbers = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.lit(n).alias("length")) for k, n in enumerate(lengths)])).alias("x")
        whole = distinct.where("c > 1").select("key", "f", numbers, F.col("lo").alias("l"), F.col("hi").alias("r"))
        covered = whole.where(F.col("l") + F.col("r") >= F.col("x.length")).select("key", "f", "x.which", "l", "r")
        for p in parts:
            covered = covered.unionByName(p)
        covered = put(covered.groupBy("key", "f", "which").agg(F.max("l").alias("l"), F.max("r").alias("r")))
        own = merge_split(found.select("key", "f", "_doc", "_t", "at"), covered, ["key", "f"], heavy(distinct.withColumnRenamed("c", "n"), ["key", "f"]), ["_doc", "at"])
        pairs = own.select("_doc", "_t", "which", (F.col("at") - F.col("l")).alias("s"), (F.col("at") + F.col("r")).alias("e"))
        by_start = Window.partitionBy("_doc", "_t", "which").orderBy("s", "e")
        before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
        runs = pairs.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy("_doc", "_t", "which", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
        return cut(runs.groupBy("_doc", "_t", "which").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, large: int = LARGE, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (merged spans, in order), kept (the remaining bytes), kept_sha256 and passages (spans) of every row."""
    found = spans(docs, (length, min(passage, length)), core, large)
    found = found.groupBy("_doc", "_t").agg(*[F.max(F.when(F.col("which") == k, F.col("spans"))).alias(f"s{k}") for k in (0, 1)])
    texts = docs.select("doc_id", doc_key().alias("_doc"), F.xxhash64("text").alias("_t"), "text")

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            removed, kept, passages = [], [], []
            for data, gone, long_ in zip(texts, batch.column("s0").to_pylist(), batch.column("s1").to_pylist()):
                runs = [[x["s"], x["e"]] for x in gone or []]
                removed.append(runs)
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)])))
                passages.append([[x["s"], x["e"]] for x in long_ or [] if len(data[x["s"] : x["e"]].translate(WORD_TABLE).split()) >= words])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([len(x) - len(k) for x, k in zip(texts, kept)], pa.int64()),
                    pa.array(removed, pa.list_(pa.list_(pa.int64()))),
                    pa.array(kept, pa.binary()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array(passages, pa.list_(pa.list_(pa.int64()))),
                ],
                names=["doc_id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256", "passages"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = merge_dealt(texts, found, ["_doc", "_t"], "left").select("doc_id", "text", "s0", "s1")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, removed array<array<long>>, kept binary, kept_sha256 string, passages array<array<long>>")


def maximal_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """repeat, n_bytes, n and doc_id, start of all occurrences of every maximal repeat of at least length bytes.

    Level by level: windows of length, 2 length, 4 length ... bytes have
    anchors of their own, and 2 windows of text on either side of an anchor
    hold every repeat of 1 to 2 windows around it.  The last level is the one
    in which nothing as long as 2 windows repeats.  All contexts of a core are
    gathered in one task.
    """
    with scratch(docs.sparkSession) as put:
        parts, window = [], length
        while True:
            found = _anchor_rows(docs, window, core, 2 * window, 2 * window)
            keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
            places = merge_dealt(found, keys, ["key"]).groupBy("key", "_doc", "_t", "at", "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
            places = put(places.withColumn("f", F.xxhash64("_doc", "_t", "at")))
            rows = _contexts(docs, places).dropDuplicates(["key", "f"])
            groups = put(_groups(rows, window, core))
            own = merge_dealt(places, groups.where(F.col("l") + F.col("r") < 2 * window), ["key", "f"])
            own = own.select("repeat", (F.col("l") + F.col("r")).cast("long").alias("n_bytes"), "n", "_doc", "_t", (F.col("at") - F.col("l")).alias("start"), "c")
            # a repeat is found from each anchor in it
            parts.append(put(own.dropDuplicates(["repeat", "_doc", "_t", "start"])))
            if groups.where(F.col("l") + F.col("r") >= 2 * window).isEmpty():
                break
            window *= 2
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        rows = out.withColumn("_row", F.explode(F.expr("sequence(1, c)")))
        return cut(rows.select("repeat", "n_bytes", "n", F.col("_doc").alias("doc_id"), "start"))


def _covered_sql(n: int) -> str:
    """Views r{n} ... s{n}: the merged spans (a, b) of documents that are covered by strings of n bytes which start elsewhere too."""
    return f"""
p{n} AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * n})) AS k FROM d, unnest(range(0, greatest(n - {n - 1}, 0))) AS u(i)),
t{n} AS (SELECT k FROM p{n} GROUP BY k HAVING count(*) > 1),
r{n} AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + {n} THEN 0 ELSE 1 END AS new FROM p{n} JOIN t{n} USING (k) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g{n} AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r{n}),
s{n} AS (SELECT doc_id, run, min(i) AS a, max(i) + {n} AS b FROM g{n} GROUP BY doc_id, run)"""


#: Every window of 400 and of 256 bytes, as hexadecimal digits: for small tables.  The last pattern is a word of two-digit bytes.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),{_covered_sql(400)},{_covered_sql(256)},
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s400),
x AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM q JOIN d USING (doc_id) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS passages FROM s256 JOIN d USING (doc_id) WHERE len(regexp_extract_all(regexp_replace(substr(h, 2 * a + 1, 2 * (b - a)), '(..)', '\\1 ', 'g'), '((3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|[89A-F].) )+')) >= 51 GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(passages, 0) AS n_passages
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""

"""Near-duplicate detection with ProbMinHash.

A text is the weighted set of its shingles of 5 words (weight: how often it
occurs; a text of fewer words, but not none, is one shingle).  Similarity is
the probability Jaccard coefficient, which does not depend on the scale of the
weights and equals the Jaccard coefficient when all weights are equal.

Signature: every shingle is a Poisson process with its weight as rate; each
arrival falls in a register picked at random, and a register keeps the shingle
that arrives first.  Two texts agree in a register with a probability equal to
their similarity.  Arrivals are generated in order for all texts of a batch
together, and a process ends as soon as it is later than the latest register
of its text (early termination).

Banding: BANDS bands of ROWS registers; texts that share a band are
candidates.  A pair at similarity 0.8 is missed by all bands with probability
7e-5, at 0.9 with 3e-10.

Verification computes the similarity of candidates exactly from their texts,
and only pairs of at least THRESHOLD are links; classes are the connected
components of the links.  No bucket is ever expanded into all pairs, nor
collected.  Texts with the same words count as one.

  1. Every text of a bucket is compared with one leader, and the components of
     these links are formed.
  2. In buckets that still lie in several components, the shingles of each
     text that no other such text has are counted.  They can't be shared, so
     they bound the similarity of any two texts from above (see `bound`); a
     text with too many of them has no partner at all.
  3. The text with the least share of own shingles, the bucket's centre, is
     its second leader: edited copies lie around what they were copied from.
  4. Texts outside the most frequent component of a bucket meet all others in
     blocks, first by their bounds, four numbers each.  The texts that may have
     a partner in their block are sent there, where an index of their
     shingles gives the shares that two of them have in common, and with them
     a sharper bound; the similarity is computed where it may reach the threshold and
     the two aren't connected yet.  A block yields fewer links than it has
     texts, whatever the number of pairs, and no two texts of a bucket that are
     linked stay in different classes.

Cases: null and empty texts and texts without words have no shingle and are
classes of their own; texts with the same words are in one class whatever
their length; rows that repeat doc_id and text are members of the same class;
a null doc_id is a class id only if no other id is in the class; an empty
table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_key, merge_dealt, scratch
from .textbatch import mix, rows_of, slices, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Distinct shingles of a bucket's texts that meet in one task at once, about.
BLOCK = 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all rows, and the offsets of the rows in them."""
    n = np.diff(off)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    out_off = np.concatenate([[0], np.cumsum(count)])
    row = rows_of(out_off)
    first = off[row] + np.arange(len(row)) - out_off[row]
    left = off[row + 1] - first
    h = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        there = left > k
        h[there] += mix(hashes[first[there] + k] * _ODD[k] + _ODD[-1 - k])
    return mix(h), out_off


def weighted(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (44 bits), their weights and rows, in the order of the rows; up to 2**20 rows."""
    s, s_off = shingles(hashes, off)
    key, weight = np.unique((rows_of(s_off).astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20)), return_counts=True)
    return key & np.uint64((1 << 44) - 1), weight.astype(float), (key >> np.uint64(44)).astype(np.int64)


def signatures(element: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x REGISTERS: the element that arrives first in each register; rows without elements stay 0."""
    m = REGISTERS
    first = np.full(rows * m, np.inf)
    sig = np.zeros(rows * m, np.uint64)
    limit = np.full(rows, np.inf)
    alone = np.bincount(row, minlength=rows) == 1
    for r, e in zip(row[alone[row]].tolist(), element[alone[row]]):
        sig[r * m : (r + 1) * m] = e
    go = ~alone[row]
    element, weight, row = element[go], weight[go], row[go]
    time = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        draw = mix(element * _ODD[0] + np.uint64(step * int(_ODD[1]) % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        go = time < limit[row]
        if not go.all():
            element, weight, row, time, draw = element[go], weight[go], row[go], time[go], draw[go]
        at = row * m + (mix(draw + _ODD[2]) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        sig[at[won]] = element[won]
        live = np.flatnonzero(np.bincount(row, minlength=rows))
        limit[live] = first.reshape(rows, m)[live].max(axis=1)
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS hashes of the registers of each band."""
    s = sig.reshape(len(sig), BANDS, ROWS)
    h = np.zeros(s.shape[:2], np.uint64)
    for k in range(ROWS):
        h = mix(h * _ODD[3] + s[:, :, k] + _ODD[k])
    return h


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard coefficient of two texts given by their word hashes."""
    if not len(a) or not len(b):
        return 0.0
    (ea, wa, _), (eb, wb, _) = (weighted(x, np.array([0, len(x)])) for x in (a, b))
    return coefficient(ea, wa, eb, wb)


def coefficient(ea: np.ndarray, wa: np.ndarray, eb: np.ndarray, wb: np.ndarray) -> float:
    """The same of two weighted sets; their elements are in order."""
    every = np.union1d(ea, eb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ea)] = wa
    y[np.searchsorted(every, eb)] = wb
    both = (x > 0) & (y > 0)
    ratio, back = np.unique(x[both] / y[both], return_inverse=True)
    total = np.array([np.maximum(x, r * y).sum() for r in ratio])
    return float((x[both] / total[back]).sum()) if both.any() else 0.0


def bound(own: dict, other: dict, smallest=np.minimum) -> np.ndarray:
    """An upper bound of the similarity of texts: weight, n (distinct shingles), c (those that other texts have too) and s (their share of the weight).

    Only shingles that both have add to the similarity J.  Let X and Y be their
    shares of the two weights.  Each adds at most 1 / (1 / p + (1 - Y) / q), p and
    q its own shares, which is concave and of degree 1, so that
    J <= 1 / (1 / X + 1 / Y - 1).  X is s at most.  And as there are at most
    c of the text with fewer, and every other shingle weighs 1 at least,
    weight * (1 - X) is at least n - c.
    """
    c = smallest(own["c"], other["c"])
    x, y = (np.maximum(smallest(t["s"], 1 - (t["n"] - c) / t["weight"]), 1e-9) for t in (own, other))
    return 1 / (1 / x + 1 / y - 1)


_FACTS = ["weight", "n", "c", "s"]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, _t (hash of the text), k0 and k1 (hash of its words), weight and n (distinct) of its shingles, and its bands b0, b1, ...; null bands for texts without words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, off = word_hashes(part.column("text"))
                n, rows = np.diff(off), part.num_rows
                element, weight, row = weighted(hashes, off)
                bands = band_keys(signatures(element, weight, row, rows))
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(off[:-1], n).astype(np.uint64)
                keys = []
                for c in (0, 1):
                    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes * _ODD[c] + mix(place + _ODD[c + 2])))])
                    keys.append(mix(upto[off[1:]] - upto[off[:-1]] + n.astype(np.uint64)))
                none = n == 0
                cols = [part.column("doc_id"), part.column("_t"), *(pa.array(k.view(np.int64)) for k in keys)]
                cols += [pa.array(np.bincount(row, w, rows).astype(np.int64)) for w in (weight, None)]
                cols += [pa.array(np.ascontiguousarray(bands[:, b]).view(np.int64), mask=none) for b in range(BANDS)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "_t", "k0", "k1", "weight", "n", *(f"b{b}" for b in range(BANDS))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_t")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`{c}` long" for c in names[1:]))


def facts(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, weight, n, c and s of the given texts (rep, text): c and s leave out the shingles that no other of them has."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                element, weight, row = weighted(*word_hashes(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), part.column("rep").take(pa.array(row)), pa.array(weight.astype(np.int64))], names=["e", "rep", "w"])

    each = texts.select("rep", "text").mapInArrow(run, "e long, rep long, w long")
    alone = each.groupBy("e").agg(F.count(F.lit(1)).alias("df"), F.min("rep").alias("rep"), F.min("w").alias("w")).where("df = 1")
    own = alone.groupBy("rep").agg(F.count(F.lit(1)).alias("own"), F.sum("w").alias("own_weight"))
    left = merge_dealt(merge_dealt(reps.select("rep", "weight", "n"), texts.select("rep"), ["rep"], "left_semi"), own, ["rep"], "left").fillna(0, ["own", "own_weight"])
    return left.select("rep", "weight", "n", (F.col("n") - F.col("own")).alias("c"), (1 - F.col("own_weight") / F.col("weight")).alias("s"))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold. texts: rep and text."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    met = merge_dealt(merge_dealt(pairs, left, ["a"]), right, ["b"]).select("a", "b", "x", "y")

    def run(batches):
        @functools.lru_cache(64)
        def words(text: str) -> np.ndarray:
            return word_hashes(pa.array([text], pa.large_string()))[0]

        for batch in batches:
            ok = [similarity(words(x), words(y)) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """rep and root (one id of its component) of all ids in edges (a, b).

    Each round every id goes to the first of its neighbours in a hashed order,
    and the edges between the ids that are left are contracted, which leaves a
    fraction of the ids whatever the shape of the graph; only tables of edges move.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        to = cut(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("rep"), F.least(order("a"), "m")["id"].alias("to")))
        to_a, to_b = (to.select(F.col("rep").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        edges = merge_dealt(merge_dealt(edges, to_a, ["a"]), to_b, ["b"]).select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = cut(edges.where("a <> b").distinct())
        if roots is None:
            roots = to.select("rep", F.col("to").alias("root"))
        else:
            moved = to.select(F.col("rep").alias("root"), "to")
            roots = merge_dealt(roots, moved, ["root"], "left").select("rep", F.coalesce("to", "root").alias("root"))
    return roots if roots is not None else edges.select(F.col("a").alias("rep"), F.col("b").alias("root"))


def _buckets(reps: DataFrame) -> DataFrame:
    """rep, band and h (bucket), a row for each band."""
    rows = reps.where("b0 IS NOT NULL").select("rep", F.posexplode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("band", "key"))
    return rows.select("rep", "band", F.xxhash64("band", "key").alias("h"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of both together."""
    of = lambda c: roots.select(F.col("rep").alias(c), F.col("root").alias(f"r{c}"))
    lifted = merge_dealt(merge_dealt(links, of("a"), ["a"], "left"), of("b"), ["b"], "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    second = cut(components(lifted))
    moved = second.select(F.col("rep").alias("root"), F.col("root").alias("to"))
    old = merge_dealt(roots, moved, ["root"], "left").select("rep", F.coalesce("to", "root").alias("root"))
    return cut(old.union(merge_dealt(second, roots.select("rep"), ["rep"], "left_anti").select("rep", "root")))


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """h, rep and root of all buckets that lie in several components, and their most frequent root."""
    placed = merge_dealt(buckets.select("h", "rep"), roots, ["rep"], "left").select("h", "rep", F.coalesce("root", "rep").alias("root"))
    by_root = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"))
    sizes = by_root.groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("most")).where("roots > 1")
    # one more key than the aggregation has, so that the planner may split hot buckets
    return merge_dealt(placed.withColumn("g", F.hash("h")), sizes.select("h", F.hash("h").alias("g"), F.col("most.root").alias("most")), ["h", "g"]).drop("g")


def _centres(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's texts with its centre, which lies in another component, with the facts of both."""
    first = F.min(F.struct((F.lit(1.0) - F.col("s")).alias("o"), F.xxhash64("rep").alias("o2"), "rep", "root", *_FACTS)).alias("x")
    centres = rows.groupBy("h").agg(first).select("h", F.hash("h").alias("g"), F.col("x.rep").alias("b"), F.col("x.root").alias("rb"), *[F.col(f"x.{f}").alias(f"{f}_b") for f in _FACTS])
    return merge_dealt(rows.withColumn("g", F.hash("h")), centres, ["h", "g"]).where("root <> rb").withColumnRenamed("rep", "a")


def _columns(batch: pa.RecordBatch, suffix: str = "") -> dict[str, np.ndarray]:
    return {f: batch.column(f + suffix).to_numpy(zero_copy_only=False) for f in _FACTS}


def _possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bound reaches the threshold."""

    def run(batches):
        for batch in batches:
            ok = bound(_columns(batch), _columns(batch, "_b")) >= threshold - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", *_FACTS, *[f"{f}_b" for f in _FACTS]).mapInArrow(run, "a long, b long").distinct()


_PLACE = ["h", "ub", "mb"]


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """_PLACE, rep, root, facts and few: every text outside the most frequent component of its bucket (few) meets every text of the bucket in one place."""
    sizes = rows.groupBy("h").agg(F.ceil(F.sum("n") / block).alias("nm"), F.ceil(F.sum(F.when(F.col("root") != F.col("most"), F.col("n"))) / block).alias("nu"))
    rows = merge_dealt(rows.withColumn("g", F.hash("h")), sizes.withColumn("g", F.hash("h")), ["h", "g"])
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    names = [*_PLACE, "rep", "root", *_FACTS, "few"]
    few = rows.where("root <> most").withColumn("ub", place("nu")).withColumn("mb", every("nm")).withColumn("few", F.lit(True))
    many = rows.where("nu > 0").withColumn("mb", place("nm")).withColumn("ub", every("nu")).withColumn("few", F.lit(False))
    return few.select(*names).union(many.select(*names))


def _by_place(rows: DataFrame, meet, schema: str) -> DataFrame:
    """What meet makes of the rows of each place."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of one place, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in _PLACE])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and any(held[0].column(c)[0] != batch.column(c)[a] for c in _PLACE):
                    yield meet(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield meet(pa.Table.from_batches(held))

    return rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(run, schema)


def _touched(dealt: DataFrame, threshold: float) -> DataFrame:
    """The rows of dealt whose bound with a text of another component reaches the threshold in their place."""

    def meet(group: pa.Table) -> pa.RecordBatch:
        rep, root, flag = (group.column(c).to_numpy() for c in ("rep", "root", "few"))
        facts_ = {f: group.column(f).to_numpy() for f in _FACTS}
        some, all_ = np.flatnonzero(flag), np.flatnonzero(~flag)
        others = {f: x[all_] for f, x in facts_.items()}
        hit = np.zeros(len(rep), bool)
        for i in some:
            own = (bound(others, {f: x[i] for f, x in facts_.items()}) >= threshold - 1e-9) & (root[all_] != root[i])
            hit[all_[own]] = True
            hit[i] = own.any()
        kept = pa.table({**{c: group.column(c) for c in [*_PLACE, "rep", "root"]}, "few": pa.array(flag)}).filter(pa.array(hit))
        return kept.combine_chunks().to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], schema=kept.schema)

    return _by_place(dealt, meet, ", ".join(f"{c} long" for c in [*_PLACE, "rep", "root"]) + ", few boolean")


def _links(touched: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect the components of each place. touched: _PLACE, rep, root, few and text."""

    def meet(group: pa.Table) -> pa.RecordBatch:
        rep, root, flag = (group.column(c).to_numpy() for c in ("rep", "root", "few"))
        element, weight, row = weighted(*word_hashes(group.column("text")))
        off = np.searchsorted(row, np.arange(len(rep) + 1))
        total = np.bincount(row, weight, len(rep))
        _, element = np.unique(element, return_inverse=True)
        parent = {int(r): int(r) for r in root}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        marked = np.zeros(element.max(initial=-1) + 1)
        a, b = [], []
        for i in np.flatnonzero(flag):
            e, w = element[off[i] : off[i + 1]], weight[off[i] : off[i + 1]]
            marked[e] = w
            there = marked[element]
            marked[e] = 0
            x = np.maximum(np.bincount(row, there, len(rep)) / total[i], 1e-9)
            y = np.maximum(np.bincount(row, weight * (there > 0), len(rep)) / total, 1e-9)
            for j in np.flatnonzero(~flag & (1 / (1 / x + 1 / y - 1) >= threshold - 1e-9)):
                p, q = find(int(root[i])), find(int(root[j]))
                if p != q and coefficient(e, w, element[off[j] : off[j + 1]], weight[off[j] : off[j + 1]]) >= threshold:
                    parent[p] = q
                    a.append(int(rep[i]))
                    b.append(int(rep[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_place(touched, meet, "a long, b long").distinct()


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, _t, class_id (least doc_id), class_size and kept (one row of each class) of every row."""
    with scratch(docs.sparkSession) as put:
        made = put(sketches(docs).withColumn("uid", F.monotonically_increasing_id()))
        reps = put(made.groupBy("k0", "k1").agg(F.min("uid").alias("rep"), *[F.max(c).alias(c) for c in ("weight", "n", *(f"b{b}" for b in range(BANDS)))]))
        buckets = put(_buckets(reps))
        least = buckets.groupBy("h").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1")
        # one more key than the aggregation has, so that the planner may split hot buckets
        star = merge_dealt(buckets.select("h", F.hash("h").alias("g"), F.col("rep").alias("a")), least.select("h", F.hash("h").alias("g"), "b"), ["h", "g"])
        pairs = put(star.where("a <> b").select("a", "b").distinct())
        # the texts of all candidates meet their ids once
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = merge_dealt(made.select(F.col("uid").alias("rep"), doc_key().alias("_doc"), "_t"), ids, ["rep"])
        texts = docs.select(doc_key().alias("_doc"), F.xxhash64("text").alias("_t"), "text")
        texts = put(merge_dealt(texts, wanted, ["_doc", "_t"]).select("rep", "text").dropDuplicates(["rep"]))
        roots = cut(components(verify(pairs, texts, threshold)))
        left = put(_open(buckets, roots))
        if not left.isEmpty():
            known = put(facts(merge_dealt(texts, left.select("rep").distinct(), ["rep"], "left_semi"), reps).where(F.col("s") >= threshold - 1e-9))
            alive = put(merge_dealt(buckets.select("h", "rep"), known.select("rep"), ["rep"], "left_semi"))
            near = put(_possible(_centres(merge_dealt(_open(alive, roots), known, ["rep"])), threshold))
            roots = _merged(roots, verify(near, texts, threshold))
            some = put(_touched(_dealt(put(merge_dealt(_open(alive, roots), known, ["rep"])), block), threshold))
            roots = _merged(roots, put(_links(merge_dealt(some, texts, ["rep"]), threshold)))
        of_words = merge_dealt(reps.select("k0", "k1", "rep"), roots, ["rep"], "left").select("k0", "k1", F.xxhash64("k0").alias("_g"), F.coalesce("root", "rep").alias("root"))
        mine = made.select("uid", "doc_id", "_t", "k0", "k1", F.xxhash64("k0").alias("_g"), F.col("b0").isNull().alias("wordless"))
        placed = put(merge_dealt(mine, of_words, ["k0", "k1", "_g"]).select("uid", "doc_id", "_t", F.when(F.col("wordless"), F.col("uid")).otherwise(F.col("root")).alias("root")))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid")).alias("first")
        classes = placed.groupBy("root").agg(first, F.count(F.lit(1)).alias("class_size"))
        out = merge_dealt(placed.withColumn("_g", F.hash("root")), classes.withColumn("_g", F.hash("root")), ["root", "_g"])
        return cut(out.select("doc_id", "_t", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("first.uid")).alias("kept")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs of each class, with the columns of docs."""
    kept = near_classes(docs).where("kept").select(doc_key().alias("_doc"), "_t").distinct()
    # rows that repeat id and text are reduced before they move, however many there are
    one = docs.withColumn("_doc", doc_key()).withColumn("_t", F.xxhash64("text")).dropDuplicates(["_doc", "_t"])
    return merge_dealt(one, kept, ["_doc", "_t"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

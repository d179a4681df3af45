"""LM scoring by masked pseudo-likelihood.

Every word of a text is predicted from the K words on either side by a small
bidirectional window network (embeddings, one tanh layer, softmax), written in
numpy; the sum of the conditional log-probabilities scores the document.

The network's classes are the VOCABULARY most frequent words of the whole
corpus and BUCKETS hash buckets.  A word outside the vocabulary has probability
P(bucket | context) x P(word | bucket): the second factor comes from the counts
of all words, discounted by DISCOUNT, and what the discount frees goes to a
spelling model (byte pairs of the distinct words), so that unseen words have a
probability of their own too.  The shares of a bucket's words sum to 1 at most.
Word counts cover all documents and are summed in Spark; about HEAD frequent
words are broadcast, all others reach the texts by a join.

The network is trained on all documents too, on every place once.  Texts, as
rows of class numbers, are dealt to shards of about SHARD words by a hash of
doc_id and text, and lie in the order of that hash.  In every round each
shard starts from the same weights, walks through its rows, masks its round's
share of the places (picked by a hash of shard and place; the rounds' shares
together are all places), and gives its weights with the number of places it has
seen; the weighted mean, formed in a tree of tasks in the order of the shards,
begins the next round.  So the model depends on the rows only, not on files or partitions.

Cases: null and empty texts have 0 words, log_prob 0 and a null mean; an empty
table gives an empty result; a corpus without words leaves the network as
it began; repeated rows give repeated results.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, merge_dealt, scratch
from .textbatch import LOWER, WORD_HASH, WORD_TABLE, column_bytes, hash_word, mix, rows_of, slices, word_hashes, word_spans

VOCABULARY = 192
BUCKETS = 63
#: Taken off the count of each word of a bucket.
DISCOUNT = 0.5
#: Words whose shares are broadcast, about; the others are joined.
HEAD = 1 << 18
#: Words on either side.
K = 3
DIM, HIDDEN = 12, 32
ROUNDS, RATE, STEP = 2, 0.5, 512
#: Places scored by one matrix product.
PLACES = 2048
#: Words of a shard, and of the part of it whose places are shuffled together, about.
SHARD, CHUNK = 1 << 21, 1 << 17


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of every word of all documents."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").cast(pa.large_binary()).to_pylist():
                    if text:
                        counts.update(text.translate(WORD_TABLE).split())
                if len(counts) > 300_000:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Number of the border of a word among the bytes.
_BORDER = 256


def _pairs(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of the byte pairs of the words: first each border and first byte, then last bytes, then pairs inside."""
    inside = np.zeros(len(lower) + 1, np.int64)
    inside[starts + 1] += 1
    inside[ends] -= 1
    at = np.flatnonzero(np.cumsum(inside[: len(lower)]))
    x = lower.astype(np.int64)
    return np.concatenate([_BORDER * 257 + x[starts], x[ends - 1] * 257 + _BORDER, x[at - 1] * 257 + x[at]])


class Rare:
    """What is known of the words outside the vocabulary, but for the joined ones."""

    def __init__(self, buckets: int):
        self.total, self.distinct = np.zeros(buckets), np.zeros(buckets)
        self.pairs = np.zeros(257 * 257)
        self.hashes, self.shares = np.zeros(0, np.uint64), np.zeros(0)
        self.finish()

    def finish(self) -> None:
        seen = self.total > 0
        self.freed = np.where(seen, np.log(np.where(seen, DISCOUNT * self.distinct, 1) / np.maximum(self.total, 1)), 0.0)
        n = self.pairs.reshape(257, 257) + 0.01
        self.spell = np.log(n / n.sum(axis=1, keepdims=True))
        # the first of the sorted hashes with each value of the 20 first bits
        self.first = np.searchsorted(self.hashes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def spelled(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each word's spelling."""
        if not len(starts):
            return np.zeros(0)
        upto = np.zeros(len(lower))
        np.cumsum(self.spell[lower[:-1], lower[1:]], out=upto[1:])
        return self.spell[_BORDER, lower[starts]] + upto[ends - 1] - upto[starts] + self.spell[lower[ends - 1], _BORDER]

    def head(self, hashes: np.ndarray) -> np.ndarray:
        """The discounted share of each word, 0 if it isn't broadcast."""
        out = np.zeros(len(hashes))
        if not len(self.hashes):
            return out
        slot = (hashes >> np.uint64(44)).astype(np.int32)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):  # one look for each word of the slot, few on average
            k = at[left]
            same = self.hashes[k] == hashes[left]
            out[left[same]] = self.shares[k[same]]
            at[left] = k + 1
            left = left[~same & (k + 1 < end[left])]
        return out


class Network:
    """The alphabet and the weights; rare and tail (h and share of the words that are joined) describe all other words."""

    def __init__(self, words: list[bytes], buckets: int = BUCKETS):
        h = np.array([hash_word(w) for w in words], np.uint64)
        self.order = np.argsort(h).astype(np.int64)
        self.hashes = h[self.order]
        self.words, self.buckets = len(words), buckets
        self.size = len(words) + buckets
        self.rare, self.tail = Rare(buckets), None
        rng = np.random.default_rng(5)
        width = 2 * K * DIM
        # one more embedding stands for places outside the text
        self.emb = rng.normal(0, 0.3, (self.size + 1, DIM)).astype(np.float32)
        self.w1 = rng.normal(0, width**-0.5, (width, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = rng.normal(0, 0.1 * HIDDEN**-0.5, (HIDDEN, self.size)).astype(np.float32)
        self.b2 = np.zeros(self.size, np.float32)

    def __getstate__(self):
        return self.__dict__ | {"tail": None}  # a table stays with the driver

    def weights(self) -> list[np.ndarray]:
        return [self.emb, self.w1, self.b1, self.w2, self.b2]

    def flat(self) -> bytes:
        return np.concatenate([w.ravel() for w in self.weights()]).astype("<f8").tobytes()

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for w in self.weights():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Alphabet numbers of word hashes."""
        out = self.words + (mix(hashes) % np.uint64(self.buckets)).astype(np.int64)
        if self.words:
            at = np.minimum(np.searchsorted(self.hashes, hashes), self.words - 1)
            known = self.hashes[at] == hashes
            out[known] = self.order[at[known]]
        return out

    def padded(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows with K numbers of the outside between them, and the place of each word there."""
        at = np.arange(len(ids)) + K * (rows_of(off) + 1)
        out = np.full(len(ids) + K * len(off), self.size, np.int32)
        out[at] = ids
        return out, at

    @staticmethod
    def contexts(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each place the 2 K words around it; places outside its row have the last number."""
        return padded[at[:, None] + np.array([d for d in range(-K, K + 1) if d])]

    def _forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.emb[context].reshape(len(context), -1)
        h = np.tanh(x @ self.w1 + self.b1)
        return x, h, h @ self.w2 + self.b2

    @staticmethod
    def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In place: exp(logits - shift), its sums by row, and the shift, 0 unless numbers would be too large or small."""
        shift = np.zeros((len(logits), 1), np.float32)
        if logits.size and (logits.max() > 40 or logits.min() < -40):
            shift = logits.max(axis=1, keepdims=True)
            logits -= shift
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], np.float32), shift[:, 0]

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        logits = self._forward(context)[2]
        own = logits[np.arange(len(target)), target].astype(np.float64)
        _, total, shift = self._exponentials(logits)
        return own - shift - np.log(total.astype(np.float64))

    def gradients(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the mean loss of the places, by each of the weights."""
        n = len(target)
        x, h, p = self._forward(context)
        _, total, _ = self._exponentials(p)
        p *= (1 / (n * total))[:, None]
        p[np.arange(n), target] -= np.float32(1 / n)
        back = (p @ self.w2.T) * (1 - h * h)
        by_word = back @ self.w1.T
        at = np.arange(self.emb.size).reshape(self.emb.shape)[context].reshape(-1)
        demb = np.bincount(at, by_word.reshape(-1), self.emb.size).reshape(self.emb.shape).astype(np.float32)
        return demb, x.T @ back, back.sum(0), h.T @ p, p.sum(0)

    def step(self, context: np.ndarray, target: np.ndarray, state: list[np.ndarray]) -> None:
        """One Adagrad step on the mean loss of the places."""
        for w, g, s in zip(self.weights(), self.gradients(context, target), state):
            s += g * g
            w -= (RATE * 0.1) * g / (np.sqrt(s) + 1e-6)

    def score(self, col: pa.Array) -> tuple[np.ndarray, ...]:
        """Words and summed log-probability of each row, without the words that must be joined; of these row, hash, number and the log-probability as unseen words."""
        buf, off = column_bytes(col)
        lower = LOWER[buf]
        starts, ends, off = word_spans(lower, off)
        hashes = mix(WORD_HASH.spans(WORD_HASH.prefix(lower), starts, ends))
        ids, row = self.ids(hashes), rows_of(off)
        out = np.zeros(len(off) - 1)
        padded, at = self.padded(ids, off)
        for a in range(0, len(ids), PLACES):
            own = slice(a, a + PLACES)
            out += np.bincount(row[own], self.log_probs(self.contexts(padded, at[own]), ids[own]), len(out))
        other = np.flatnonzero(ids >= self.words)
        unseen = self.rare.spelled(lower, starts[other], ends[other]) + self.rare.freed[ids[other] - self.words]
        share = self.rare.head(hashes[other])
        known = share > 0
        out += np.bincount(row[other[known]], np.log(share[known] + np.exp(unseen[known])), len(out))
        left, unseen = other[~known], unseen[~known]
        order = np.lexsort((hashes[left], row[left]))
        r, h = row[left][order], hashes[left][order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        return np.diff(off), out, r[first], h[first], np.diff(np.append(first, len(order))), unseen[order[first]]


def dealt(docs: DataFrame, network: Network, shards: int) -> DataFrame:
    """shard, key and ids (class numbers, 16 bits each) of every text with words, a shard's rows together and in order."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for batch in batches:
            for part in slices(batch):
                hashes, off = word_hashes(part.column("text"))
                data, at = net.ids(hashes).astype("<u2").tobytes(), (2 * off).tolist()
                some = np.flatnonzero(np.diff(off))
                ids = pa.array([data[at[k] : at[k + 1]] for k in some.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("shard").take(pa.array(some)), part.column("key").take(pa.array(some)), ids], names=["shard", "key", "ids"])

    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    rows = docs.select("text", F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key")).mapInArrow(run, "shard long, key long, ids binary")
    # more partitions than shards, so that few of them hold several
    return rows.repartition(min(4 * shards, 20_000), "shard").sortWithinPartitions("shard", "key", "ids")


def _train_round(rows: DataFrame, network: Network, number: int, rounds: int) -> DataFrame:
    """shard, weights and n (places seen) of each shard of dealt rows."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        from copy import deepcopy

        class Shard:
            def __init__(self, name: int):
                self.name, self.net, self.at, self.seen, self.held, self.size = name, deepcopy(shared.value), 0, 0, [], 0
                self.state = [np.full_like(w, 1e-8) for w in self.net.weights()]

            def add(self, ids: bytes) -> None:
                self.held.append(ids)
                self.size += len(ids) // 2
                if self.size >= CHUNK:
                    self.learn()

            def learn(self) -> None:
                off = np.concatenate([[0], np.cumsum([len(x) // 2 for x in self.held])])
                ids = np.frombuffer(b"".join(self.held), "<u2").astype(np.int64)
                self.held, self.size = [], 0
                draw = mix(mix(np.arange(self.at, self.at + len(ids), dtype=np.uint64) + np.uint64(self.name << 40)) + np.uint64(1))
                self.at += len(ids)
                places = np.flatnonzero((draw >= np.uint64((number << 64) // rounds)) & (draw <= np.uint64((number + 1 << 64) // rounds - 1)))
                places = places[np.argsort(draw[places])]  # neighbours in a step come from different texts
                padded, at = self.net.padded(ids, off)
                for a in range(0, len(places), STEP):
                    own = places[a : a + STEP]
                    self.net.step(self.net.contexts(padded, at[own]), ids[own], self.state)
                self.seen += len(places)

            def row(self) -> pa.RecordBatch:
                if self.held:
                    self.learn()
                return _weights_row(self.name, self.net.flat(), self.seen)

        shard = None
        for batch in batches:
            for name, ids in zip(batch.column("shard").to_pylist(), batch.column("ids")):
                if shard is None or shard.name != name:
                    if shard is not None:
                        yield shard.row()
                    shard = Shard(name)
                shard.add(ids.as_py())
        if shard is not None:
            yield shard.row()

    return rows.mapInArrow(run, "shard long, weights binary, n long")


def _weights_row(shard: int, flat: bytes, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([flat], pa.binary()), pa.array([n], pa.int64())], names=["shard", "weights", "n"])


#: Networks that a task of the tree adds up.
FAN = 16


def _means(batches):
    """The weighted mean of each FAN shards, in their order; their number is that of the group."""
    at, total, n = None, None, 0
    for batch in batches:
        for shard, flat, k in zip(*(batch.column(c).to_pylist() for c in ("shard", "weights", "n"))):
            if shard // FAN != at:
                if n:
                    yield _weights_row(at, (total / n).tobytes(), n)
                at, total, n = shard // FAN, 0.0, 0
            total, n = total + np.frombuffer(flat, "<f8") * k, n + k
    if n:
        yield _weights_row(at, (total / n).tobytes(), n)


def _learn_rare(counts: DataFrame, network: Network, head: int) -> None:
    """Sets rare and tail of the network from the counts of all words."""
    shared = counts.sparkSession.sparkContext.broadcast(network)

    def hashed(batches):
        net = shared.value
        for batch in batches:
            h, _ = word_hashes(batch.column("word"))
            ids = net.ids(h)
            keep = np.flatnonzero(ids >= net.words)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array((ids[keep] - net.words).astype(np.int32)), batch.column("n").take(pa.array(keep))], names=["h", "bucket", "n"])

    def spelling(batches):
        net, sums = shared.value, np.zeros(257 * 257, np.int64)
        for batch in batches:
            buf, off = column_bytes(batch.column("word"))
            lower = LOWER[buf]
            starts, ends, _ = word_spans(lower, off)
            other = net.ids(mix(WORD_HASH.spans(WORD_HASH.prefix(lower), starts, ends))) >= net.words
            sums += np.bincount(_pairs(lower, starts[other], ends[other]), minlength=257 * 257)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    words = cut(counts.mapInArrow(hashed, "h long, bucket int, n long"))
    rare = Rare(network.buckets)
    for r in words.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        rare.total[r.bucket], rare.distinct[r.bucket] = r.n, r.v
    for r in counts.select("word").mapInArrow(spelling, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        rare.pairs[r.pair] = r.n
    # the least power of 2^(1/8) that at most `head` words reach
    step = F.floor(F.log2("n") * 8)
    least, room = None, head
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.col("step").desc()).collect():
        if r.v > room:
            break
        least, room = r.step, room - r.v
    total = F.element_at(F.array(*[F.lit(float(x)) for x in rare.total]), F.col("bucket") + 1)
    shares = words.withColumn("share", (F.col("n") - DISCOUNT) / total)
    if least is not None:
        own = shares.where(step >= least).select("h", "share").toArrow()
        h = own.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        rare.hashes, rare.shares = h[order], own.column("share").to_numpy()[order]
        shares = shares.where(step < least)
    rare.finish()
    network.rare, network.tail = rare, shares.select("h", "share")


def train(docs: DataFrame, vocabulary: int = VOCABULARY, buckets: int = BUCKETS, rounds: int = ROUNDS, head: int = HEAD, shard: int = SHARD) -> Network:
    """The network after `rounds` passes over all documents."""
    counts = cut(word_counts(docs))
    top = counts.orderBy(F.col("n").desc(), "word").limit(vocabulary).collect()
    network = Network([bytes(r.word) for r in top], buckets)
    _learn_rare(counts, network, head)
    words = counts.agg(F.sum("n")).first()[0] or 0
    shards = -(-words // shard)
    if not shards:
        return network
    with scratch(docs.sparkSession) as put:
        rows = put(dealt(docs, network, shards))
        for k in range(rounds):
            sent, left = _train_round(rows, network, k, rounds), shards
            while True:  # a tree: no task gets more than FAN networks
                left = (left + FAN - 1) // FAN
                group = F.floor(F.col("shard") / FAN)
                sent = sent.repartition(min(left, 20_000), group).sortWithinPartitions("shard").mapInArrow(_means, "shard long, weights binary, n long")
                if left == 1:
                    break
            for r in sent.collect():
                network.load(np.frombuffer(bytes(r.weights), "<f8"))
    return network


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_words, log_prob (summed), mean_log_prob and pseudo_perplexity of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                n, lp, row, h, k, unseen = shared.value.score(part.column("text"))
                r = np.arange(at, at + len(n))
                at += len(n)
                # rows of documents have a hash too, so that they are spread in the join
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([r, r[row]])),
                        pa.array(np.concatenate([mix(r.astype(np.uint64)), h]).view(np.int64)),
                        pa.concat_arrays([pa.nulls(len(r), pa.int64()), pa.array(k, pa.int64())]),
                        pa.concat_arrays([pa.array(lp), pa.array(unseen)]),
                        part.column("doc_id").take(pa.array(np.concatenate([np.arange(len(r)), row]))),
                        pa.concat_arrays([pa.array(n, pa.int64()), pa.array(np.zeros(len(k), np.int64))]),
                    ],
                    names=["r", "h", "k", "lp", "doc_id", "n_words"],
                )

    out = docs.select("doc_id", "text").mapInArrow(run, f"r long, h long, k long, lp double, doc_id {kind}, n_words long")
    if network.tail is None:
        out = out.withColumn("share", F.lit(None).cast("double"))
    else:
        out = merge_dealt(out, network.tail.groupBy("h").agg(F.max("share").alias("share")), ["h"], "left")
    own = F.when(F.col("k").isNull(), F.col("lp")).otherwise(F.col("k") * F.when(F.col("share").isNull(), F.col("lp")).otherwise(F.log(F.col("share") + F.exp("lp"))))
    out = out.groupBy("r").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum(own).alias("log_prob")).drop("r")
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return out.withColumn("mean_log_prob", mean).withColumn("pseudo_perplexity", F.exp(-mean))

"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words and the beginnings of words (PREFIXES bytes, for words of the
same stem).  Training counts, over every labelled text and in Spark, in how
many toxic and clean texts each token occurs.  A token's score is its log-odds
ratio between the two with an informative Dirichlet prior (the corpus
frequency, PRIOR times as strong as the corpus); only tokens whose score is
significant (|z| >= Z) have one.  A word scores what its most telling token
does, the k-th time in a text a k-th of it, and every word pays DRIFT, so that
the expected score of clean text is negative.

A text is scanned once from left to right for all its maximal scoring
segments.  Under clean text the score S of the best segment of n words has an
extreme-value law, P(S > s) = 1 - exp(-K n exp(-lambda s)); lambda and K come
from the clean training counts.  Each segment's normalised score is
lambda S - ln(K n); segments above 0 are reported as passages, and the
document's evidence is their sum.  A logistic curve turns it into a probability.
It is fitted to the evidence of all labelled texts, of each by the tokens of the
other folds: texts are in one of FOLDS by a hash, so that equal texts share a
fold, and each fold has a table of token scores that was counted without it.

The discount of repeated tokens only lowers scores, so that the extreme-value law
of undiscounted scores still bounds the chance of a passage in clean text.

The model is a table of all significant tokens, which is broadcast; if there
are more than MAX_TOKENS (24 MB) training fails.  Training moves the labelled texts once, to
meet their labels; calibration and scoring move only ids and numbers.

Cases: null and empty texts and texts without scored words have evidence 0
and the score that goes with it; without labels of either class every score is
0; a document labelled both ways counts as toxic; repeated rows give repeated
results; an empty table gives an empty result.  Only doc_id and text are read
of documents, and doc_id and toxic of labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_key
from .textbatch import LOWER, WORD_HASH, column_bytes, mix, rows_of, slices, word_spans

PRIOR = 0.1
Z = 3.0
CAP = 6.0
DRIFT = 0.5
MAX_TOKENS = 1_000_000
#: Parts of the labelled texts for the calibration.
FOLDS = 3
#: Bytes of the beginnings of longer words that are tokens too.
PREFIXES = (4, 5, 6, 7, 8)
#: Distinct tokens that a training task holds before it sends them.
HELD = 1_000_000
THRESHOLD = 0.7
#: Evidence is counted in steps of 1/STEPS up to MAX_EVIDENCE for the logistic fit.
STEPS, MAX_EVIDENCE = 4, 200


def segments(scores: list[float], places: list[int]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score), left to right, in linear time.

    scores are those of the words at places; every word between two places
    scores -DRIFT.  Each candidate keeps the cumulative score before and after
    it; a new one is merged with the nearest earlier candidate that began
    lower, if that one ends lower than the new one.
    """
    held: list[list] = []  # first, last, before, after
    total, last = 0.0, -1
    for s, p in zip(scores, places):
        total -= DRIFT * (p - last - 1)
        before, total, last = total, total + s, p
        if s <= 0:
            continue
        new = [p, p, before, total]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                held.append([*new, j])
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(a, b, after - before) for a, b, before, after, _ in held]


def tokens(col: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(places of words, hashes of their token) of whole words, then of each prefix length, and the rows' offsets in the words."""
    buf, off = column_bytes(col)
    lower = LOWER[buf]
    starts, ends, word_off = word_spans(lower, off)
    prefix = WORD_HASH.prefix(lower)
    out = [(np.arange(len(starts)), mix(WORD_HASH.spans(prefix, starts, ends)))]
    for n in PREFIXES:
        at = np.flatnonzero(ends - starts > n)
        out.append((at, mix(WORD_HASH.spans(prefix, starts[at], starts[at] + n) ^ np.uint64(n << 56 | 1))))
    return out, word_off


class Model:
    """Token scores, the extreme-value parameters and the logistic calibration."""

    def __init__(self, scores: dict[int, float], lam: float, k: float):
        self.hashes = np.sort(np.array(list(scores), np.uint64))
        self.scores = np.array([scores[h] for h in self.hashes.tolist()], float)
        self.lam, self.k = lam, k
        self.slope, self.shift = 0.0, -60.0

    def word_scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of scored words, their scores, and the rows' offsets in the words."""
        found, off = tokens(col)
        value, token = np.zeros(off[-1]), np.zeros(off[-1], np.uint64)
        if len(self.hashes):
            for at, h in found:
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[k] == h
                at, h, s = at[known], h[known], self.scores[k[known]]
                more = np.abs(s) > np.abs(value[at])
                value[at[more]], token[at[more]] = s[more], h[more]
        at = np.flatnonzero(value)
        # the k-th time that a token scores in a row counts a k-th
        row = np.searchsorted(off, at, side="right") - 1
        order = np.lexsort((at, token[at], row))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(row[order]) != 0) | (token[at[order]][1:] != token[at[order]][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        times = np.empty(len(at))
        times[order] = np.arange(len(at)) - first + 1
        return at, value[at] / times, off

    def passages(self, col: pa.Array) -> list[list[tuple[int, int, float]]]:
        """The segments of each row with a normalised score above 0: first word, last word, normalised score."""
        at, value, off = self.word_scores(col)
        value = value - DRIFT
        border, n = np.searchsorted(at, off), np.diff(off)
        found: list[list] = [[] for _ in range(len(n))]
        positive = np.concatenate([[0], np.cumsum(value > 0)])
        for r in np.flatnonzero(positive[border[1:]] > positive[border[:-1]]):
            i, j = border[r], border[r + 1]
            level = math.log(max(self.k * float(n[r]), 1e-9))
            found[r] = [(a, b, x) for a, b, s in segments(value[i:j].tolist(), (at[i:j] - off[r]).tolist()) if (x := self.lam * s - level) > 0]
        return found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -60, 60)))


def token_counts(labelled: DataFrame) -> DataFrame:
    """token (hash), whole (1: a word, 0: a beginning), and for each fold the number of texts of either label that have the token: toxic0, ... clean0, ..."""

    def merged(held: list[np.ndarray]) -> np.ndarray:
        """Rows of hash, whole, toxic, clean, summed by hash."""
        x = np.concatenate(held)
        order = np.argsort(x["h"], kind="stable")
        x = x[order]
        first = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]])) if len(x) else np.zeros(0, int)
        out = x[first].copy()
        for c in ("toxic", "clean"):
            out[c] = np.add.reduceat(x[c], first, axis=0) if len(x) else 0
        return out

    names = [f"{c}{k}" for c in ("toxic", "clean") for k in range(FOLDS)]

    def run(batches):
        kind = [("h", np.uint64), ("whole", np.int64), ("toxic", np.int64, (FOLDS,)), ("clean", np.int64, (FOLDS,))]
        held, size = [np.zeros(0, kind)], 0

        def rows(x: np.ndarray) -> pa.RecordBatch:
            counts = [pa.array(np.ascontiguousarray(x[c][:, k])) for c in ("toxic", "clean") for k in range(FOLDS)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["h"]).view(np.int64)), pa.array(np.ascontiguousarray(x["whole"])), *counts], names=["token", "whole", *names])

        for batch in batches:
            for part in slices(batch):
                found, off = tokens(part.column("text"))
                of_word = rows_of(off).astype(np.uint64)
                y, fold = (np.array(part.column(c).to_pylist(), np.int64) for c in ("toxic", "fold"))
                for k, (at, h) in enumerate(found):
                    _, pick = np.unique(mix(h + of_word[at] * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                    own = np.zeros(len(pick), kind)
                    text = of_word[at[pick]].astype(np.int64)
                    own["h"], own["whole"] = h[pick], k == 0
                    own["toxic"][np.arange(len(pick)), fold[text]] = y[text]
                    own["clean"][np.arange(len(pick)), fold[text]] = 1 - y[text]
                    held.append(own)
                    size += len(own)
                if size > 2 * HELD:
                    held = [merged(held)]
                    size = len(held[0])
                    if size > HELD:
                        yield rows(held[0])
                        held, size = [np.zeros(0, kind)], 0
        yield rows(merged(held))

    sent = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), _fold().alias("fold")).mapInArrow(run, ", ".join(f"{c} long" for c in ["token", "whole", *names]))
    return sent.groupBy("token").agg(F.max("whole").alias("whole"), *[F.sum(c).alias(c) for c in names])


def _fold():
    return F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")


def extreme_value(p_positive: dict[float, float]) -> tuple[float, float]:
    """lambda and K of clean text, whose words score p_positive's keys with these shares and -DRIFT otherwise."""
    rest = max(1 - sum(p_positive.values()), 1e-9)

    def excess(lam: float) -> float:
        return rest * math.exp(-lam * DRIFT) + sum(p * math.exp(lam * s) for s, p in p_positive.items()) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    lam = low
    mean = -rest * DRIFT + sum(p * s for s, p in p_positive.items())
    # K by its common lower estimate: the drop of the walk and its rate of records
    drop = sum(p * s * math.exp(lam * s) for s, p in p_positive.items()) - rest * DRIFT * math.exp(-lam * DRIFT)
    return lam, min(1.0, max(1e-6, mean * mean / max(drop, 1e-9) * lam))


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve with a small ridge; bins: evidence, clean, toxic."""
    x = np.array([b[0] for b in bins], float)
    n0, n1 = (np.array([b[k] for b in bins], float) for k in (1, 2))
    # one clean and one toxic text at either end keep the curve finite
    x = np.append(x, [0.0, x.max() if len(x) else 0.0])
    n0, n1 = np.append(n0, [1.0, 0.02]), np.append(n1, [0.02, 1.0])
    a, b = 0.0, math.log(n1.sum() / n0.sum())
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = (n0 + n1) * np.maximum(p * (1 - p), 1e-9)
        g = n1 - (n0 + n1) * p
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum(g * x) - 1e-3 * a, np.sum(g) - 1e-3 * b]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with evidence, score, predicted and passages; columns of these names are replaced.

    passages has, from left to right, each significant passage's first and
    last word, its normalised score and its text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["evidence", "score", "predicted", "passages"]
    base = [c for c in docs.columns if c not in added]

    def run(batches):
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))
        for batch in batches:
            for part in slices(batch):
                found = m.passages(part.column("text"))
                evidence = np.array([sum(x for _, _, x in f) for f in found], float)
                p = m.probability(evidence)
                texts = [_passages(part.column("text")[k].as_py(), f) if f else [] for k, f in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in base], pa.array(evidence), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(texts, kind)], names=base + added)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in base), "evidence double, score double, predicted int, passages array<struct<first:long,last:long,score:double,text:string>>"])
    return docs.select(*[F.col(f"`{c}`") for c in base]).mapInArrow(run, schema)


def _passages(text: str, found: list[tuple[int, int, float]]) -> list[dict]:
    """The passages' own bytes in the text."""
    data = text.encode()
    starts, ends, _ = word_spans(LOWER[np.frombuffer(data, np.uint8)], np.array([0, len(data)]))
    return [{"first": int(a), "last": int(b), "score": float(x), "text": data[starts[a] : ends[b]].decode()} for a, b, x in found]


def log_odds(y1, y0, n1, n0, log, sqrt):
    """Log-odds ratio of a token with the Dirichlet prior, and its z-score; numbers, arrays or columns."""
    prior, n = (y1 + y0) * PRIOR, n1 + n0
    odds = lambda y, n_y: log((y + prior) / (n_y + PRIOR * n - y - prior))
    delta = odds(y1, n1) - odds(y0, n0)
    return delta, delta / sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def _without(fold: int, c: str) -> list[str]:
    """The counts of all other folds; of all folds for FOLDS itself."""
    return [f"{c}{k}" for k in range(FOLDS) if k != fold]


def _fitted(rows: dict[str, np.ndarray], totals: dict[str, int], fold: int) -> Model:
    """The model of all folds but one, not calibrated yet. rows: the counts of tokens that may be significant."""
    (y1, y0), (n1, n0) = ([sum(x[c] for c in _without(fold, label)) for label in ("toxic", "clean")] for x in (rows, totals))
    scores: dict[int, float] = {}
    shares: dict[float, float] = {}
    if n1 and n0:
        some = np.flatnonzero(y1 + y0 > 1)
        y1, y0, token, whole = (x[some].astype(float) if k < 2 else x[some] for k, x in enumerate((y1, y0, rows["token"], rows["whole"])))
        delta, z = log_odds(y1, y0, n1, n0, np.log, np.sqrt)
        for k in sorted(np.flatnonzero(np.abs(z) >= Z).tolist(), key=lambda k: (-abs(z[k]), int(token[k]))):
            d = max(-CAP, min(CAP, float(delta[k])))
            scores[int(token[k]) % (1 << 64)] = d
            if whole[k]:
                shares[round(d - DRIFT, 3)] = shares.get(round(d - DRIFT, 3), 0.0) + (float(y0[k]) + 0.5) / n0
    return Model(scores, *(extreme_value(shares) if shares else (1.0, 1.0)))


def _evidence(labelled: DataFrame, models: list[Model]) -> DataFrame:
    """x (evidence in steps) and toxic of every text, by the model of its fold."""
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fold = np.array(part.column("fold").to_pylist(), np.int64)
                out = np.zeros(len(fold))
                for k, m in enumerate(shared.value):
                    own = np.flatnonzero(fold == k)
                    if len(own) and len(m.hashes):
                        out[own] = [sum(x for _, _, x in f) for f in m.passages(part.column("text").take(pa.array(own)))]
                yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(np.minimum(np.floor(out * STEPS), MAX_EVIDENCE * STEPS) / STEPS)], names=["_doc", "x"])

    return labelled.select("_doc", "text", _fold().alias("fold")).mapInArrow(run, "_doc string, x double")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id and text; labels: doc_id and toxic (0 or 1) of the documents to learn from; all of them are counted."""
    own = labels.where("toxic IN (0, 1)").groupBy(doc_key().alias("_doc")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(doc_key().alias("_doc"), "text")
    # both sides are dealt at every size: labels grow with the documents
    counts = cut(token_counts(texts.hint("merge").join(own, "_doc")))
    names = [f"{c}{k}" for c in ("toxic", "clean") for k in range(FOLDS)]
    totals = {c: int(x or 0) for c, x in counts.where("whole = 1").agg(*[F.sum(c).alias(c) for c in names]).first().asDict().items()}
    significant = F.lit(False)
    for fold in range(FOLDS + 1):
        n1, n0 = (sum(totals[c] for c in _without(fold, label)) for label in ("toxic", "clean"))
        if n1 and n0:
            y1, y0 = (sum((F.col(c) for c in _without(fold, label)), F.lit(0)) for label in ("toxic", "clean"))
            z = log_odds(y1, y0, F.lit(float(n1)), F.lit(float(n0)), F.log, F.sqrt)[1]
            significant = significant | ((y1 + y0 > 1) & (F.abs(z) >= Z))
    found = counts.where(significant).limit(MAX_TOKENS + 1).toArrow()
    if found.num_rows > MAX_TOKENS:
        raise ValueError(f"more than MAX_TOKENS = {MAX_TOKENS} significant tokens: none may be dropped, raise MAX_TOKENS")
    rows = {c: found.column(c).to_numpy() for c in found.column_names}
    *parts, model = (_fitted(rows, totals, fold) for fold in range(FOLDS + 1))
    if len(model.hashes):
        seen = _evidence(texts, parts).hint("merge").join(own, "_doc")
        model.slope, model.shift = _logistic([(r.x, r.n0, r.n1) for r in seen.groupBy("x").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1")).collect()])
    return model


def held_out(fold: int = 1, folds: int = 3):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


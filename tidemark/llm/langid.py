"""Language identification with string kernels.

A text is the set of its byte n-grams of 1 to 3 bytes (lower-cased, everything
outside words as blanks, hashed to DIMS bins): a blended spectrum of presence.
The kernel of two texts is the number of bins they share over the root of the
product of their sizes.  LANDMARKS training texts give Nystroem features, and
one-versus-rest kernel ridge regression on these features gives a score for
each language.  Texts are scored in batches by two matrix products.

The model is fitted on a bounded sample of labelled rows: the PER_LANG rows of
each language with the least hash of doc_id and text (rows that repeat both
count once), or all if there are fewer.  Counts of languages cover all labelled
rows, and every language is learned.  The driver gets no texts: tasks turn the
sample into bit sets of DIMS bits, and sum the regression's normal equations
and the counts of bins.  What the driver holds is the landmarks' bit sets and
for each language a vector of DIMS numbers.  The model doesn't depend on how
the rows are dealt to tasks.

Scores say which language is nearest, not whether any is near, and their size
depends on the number of languages.  Whether a text is in its language at all
is judged by its familiarity: the mean, over the text's bins, of the share of
that language's training texts that have the bin.  The least familiarity is
learned from the training texts themselves, each against the others.

Cases: a text that is null or has no letter gives `und` with score 0; without
any labelled row every text gives `und`; with one language it is predicted for
every text with letters; repeated rows give repeated results; an empty table
gives an empty result.  Columns other than doc_id, text and, for training
only, lang are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textbatch import LOWER, WORD, column_bytes, slices

#: Bound of the training sample for each language.
PER_LANG = 400
LANDMARKS = 128
#: Landmarks of each language at least, or all its texts.
LEAST_LANDMARKS = 4
DIMS = 1 << 14
RIDGE = 1e-2
#: The least familiarity of a language is MARGIN times what all but QUANTILE of its training texts reach.
QUANTILE, MARGIN = 0.01, 0.85
#: Rows scored by one matrix product.
ROWS = 128
#: So many times PER_LANG rows pass the threshold from which the sample is taken, about.
SLACK = 3


def presence(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x DIMS, 1 where the n-gram bin occurs in the row, scaled to length 1."""
    rows = len(off) - 1
    low = LOWER[buf]
    low = np.where(WORD[low], low, 32).astype(np.uint32)
    out = np.zeros((rows, DIMS), np.float32)
    flat = out.reshape(-1)
    base = np.repeat(np.arange(rows, dtype=np.int64) * DIMS, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(low))  # bytes up to the row's end
    gram = low.copy()
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] << np.uint32(8) | low[n - 1 :] if len(gram) > 1 else gram[:0]
        mixed = (gram + np.uint32(n << 24)) * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(2246822519)
        at = base[: len(gram)] + (mixed >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64)
        flat[at[left[: len(gram)] >= n]] = 1
    size = np.sqrt(out.sum(axis=1, keepdims=True))
    out /= np.maximum(size, 1)
    return out


def bits_of(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The set of bins of each row as DIMS bits."""
    return [row.tobytes() for row in np.packbits(presence(buf, off) > 0, axis=1)]


def rows_of_bits(bits: list[bytes]) -> np.ndarray:
    """The rows that presence gives, from their bit sets."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)


def pick_landmarks(langs: list[str], landmarks: int = LANDMARKS) -> np.ndarray:
    """Places of the landmarks in the sample: evenly spaced, and LEAST_LANDMARKS of each language."""
    pick = np.unique(np.linspace(0, len(langs) - 1, min(landmarks, len(langs))).astype(int))
    every, own_lang = np.arange(len(langs)), np.array(langs)
    more = []
    for lang in sorted(set(langs)):
        own = every[own_lang == lang]
        there = np.isin(own, pick)
        more.append(own[~there][: max(0, LEAST_LANDMARKS - int(there.sum()))])
    return np.union1d(pick, np.concatenate(more).astype(int))


class Features:
    """Nystroem features: landmarks and their whitening matrix."""

    def __init__(self, z: np.ndarray):
        value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
        keep = value > 1e-6 * value.max()
        self.landmarks = np.ascontiguousarray(z.T)
        self.whiten = vector[:, keep] / np.sqrt(value[keep])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Of each row of x; the last one is constant."""
        return np.hstack([(x @ self.landmarks).astype(np.float64) @ self.whiten, np.ones((len(x), 1))])


class Model:
    """Landmarks and one weight vector for each language, and the languages' shares of texts with a bin and least familiarities."""

    def __init__(self, langs: list[str], features: Features | None = None, gram=None, sums=None, familiar=None, ridge: float = RIDGE):
        """langs in order; gram: sum of phi phi' over the sample; sums: for each language the sum of its phi."""
        self.langs = langs
        if not langs:
            return
        # the targets are 1 for the language and -1 for all others
        y = 2 * np.array(sums).T - np.sum(sums, axis=0)[:, None]
        beta = np.linalg.solve(gram + ridge * np.eye(len(gram)), y)
        self.landmarks = features.landmarks
        self.weights = (features.whiten @ beta[:-1]).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)
        self.familiar = familiar
        self.least = np.full(len(langs), -np.inf)  # of a language with one text nothing is known

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows x languages; +1 and -1 are the targets of the regression."""
        return self.scores_of(presence(buf, off))

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) @ self.weights + self.bias

    def fits(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether each row is familiar enough in its language; two standard errors, of shares at most 1/2 each, are granted to its bins."""
        own = x > 0
        size = np.maximum(own.sum(axis=1), 1)
        return np.einsum("ij,ij->i", own, self.familiar[best]) / size >= self.least[best] - 1 / np.sqrt(size)


def training_sample(labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang, key and bits of at most per_lang rows of each language, those with the least keys; a row that repeats doc_id and text counts once."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()
    if not counts:
        return labelled.select("lang", "key", F.lit(b"").alias("bits")).where("false")
    # the keys below the threshold are a few times what is taken of each language, however many rows there are
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, SLACK * (per_lang + 20) / max(r["n"], 1)))])
    at = (F.col("key") / float(1 << 64)) + 0.5
    near = labelled.where(at < F.try_element_at(share, F.col("lang")) + 1e-9).select("lang", "key", "text").dropDuplicates(["lang", "key"])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array(bits_of(*column_bytes(part.column("text"))), pa.binary())], names=["lang", "key", "bits"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return near.withColumn("_n", rank).where(F.col("_n") <= per_lang).select("lang", "key", "text").mapInArrow(run, "lang string, key long, bits binary")


def _by_lang(batches):
    """Language and rows of presence, ROWS at once, of rows that are in the order of lang."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        edges = [0, *[k for k in range(1, len(langs)) if langs[k] != langs[k - 1]], len(langs)]
        for a, b in zip(edges, edges[1:]):
            for k in range(a, b, ROWS):
                yield langs[a], rows_of_bits(batch.column("bits").slice(k, min(ROWS, b - k)).to_pylist())


def _sums(rows: DataFrame, features: Features) -> list:
    """For each language lang, n, and the sums of phi, of phi phi' and of the bins over its rows (float64 and int64 bytes)."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        of: dict[str, list] = {}
        for lang, x in _by_lang(batches):
            phi = shared.value(x)
            new = [len(x), phi.sum(axis=0), phi.T @ phi, (x > 0).sum(axis=0)]
            of[lang] = [a + b for a, b in zip(of[lang], new)] if lang in of else new
        for lang, (n, phi, gram, bins) in of.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang, "n": n, "phi": phi.tobytes(), "gram": gram.tobytes(), "bins": bins.astype(np.int64).tobytes()}])

    return rows.mapInArrow(run, "lang string, n long, phi binary, gram binary, bins binary").collect()


def _familiarities(rows: DataFrame, langs: list[str], counts: list[int], familiar: np.ndarray) -> list:
    """lang and, of every text with bins, the mean share of the language's other texts that have its bins."""
    shared = rows.sparkSession.sparkContext.broadcast(({lang: k for k, lang in enumerate(langs)}, counts, familiar))

    def run(batches):
        at, n, share = shared.value
        for lang, x in _by_lang(batches):
            k, own = at[lang], x > 0
            size = own.sum(axis=1)
            if n[k] > 1 and size.any():
                value = ((own @ (share[k].astype(np.float64) * n[k]) - size) / (n[k] - 1))[size > 0] / size[size > 0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value)), pa.array(value)], names=["lang", "value"])

    return rows.mapInArrow(run, "lang string, value double").groupBy("lang").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()


def train(labelled: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    sample = cut(training_sample(labelled, per_lang))
    picked = sample.select("lang", "key").orderBy("key", "lang").collect()
    if not picked:
        return Model([])
    chosen = [picked[k] for k in pick_landmarks([r.lang for r in picked], landmarks)]
    wanted = {(r.lang, r.key) for r in chosen}
    bits = {(r.lang, r.key): bytes(r.bits) for r in sample.where(F.col("key").isin([r.key for r in chosen])).collect() if (r.lang, r.key) in wanted}
    features = Features(rows_of_bits([bits[r.lang, r.key] for r in chosen]))
    # a language is summed in one task, in the order of its keys, so that the sums don't depend on the layout
    rows = sample.repartition("lang").sortWithinPartitions("lang", "key")
    found = sorted(_sums(rows, features), key=lambda r: r.lang)
    read = lambda x, kind=np.float64: np.frombuffer(bytes(x), kind)
    counts = [r.n for r in found]
    familiar = np.array([read(r.bins, np.int64) / r.n for r in found], np.float32)
    m = len(read(found[0].phi))
    gram = sum(read(r.gram).reshape(m, m) for r in found)
    model = Model([r.lang for r in found], features, gram, [read(r.phi) for r in found], familiar, ridge)
    for r in _familiarities(rows, model.langs, counts, familiar):
        model.least[model.langs.index(r.lang)] = MARGIN * np.quantile(r["values"], QUANTILE)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    return _predicted(docs, model).drop("_fits")


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and _fits (whether the text is in that language at all)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = [c for c in docs.columns if c not in ("lang_pred", "score", "_fits")]

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}").search
        m = shared.value
        for batch in batches:
            for wide in slices(batch):
                for k in range(0, wide.num_rows, ROWS):
                    part = wide.slice(k, ROWS)
                    texts = part.column("text").to_pylist()
                    known = np.array([bool(t) and letter(t) is not None for t in texts]) & bool(m.langs)
                    lang, score, fits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                    if known.any():
                        x = presence(*column_bytes(part.column("text")))
                        s = m.scores_of(x)
                        best = s.argmax(axis=1)
                        fits = known & m.fits(x, best)
                        lang = [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())]
                        score = np.where(known, np.clip((s[np.arange(len(best)), best].astype(float) + 1) / 2, 0, 1), 0.0)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in base], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fits)], names=[*base, "lang_pred", "score", "_fits"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in base), "lang_pred string, score double, _fits boolean"])
    return docs.select(*[F.col(f"`{c}`") for c in base]).mapInArrow(run, schema)


def held_out(fold: int = 2, folds: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is recognised, with the columns of docs."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    renamed = docs.toDF(*["text" if i == text else n for i, n in enumerate(names)])
    kept = _predicted(renamed, model).where("_fits")
    return kept.select(*[F.col("text" if i == text else n).alias(c) for i, (n, c) in enumerate(zip(names, docs.columns))])

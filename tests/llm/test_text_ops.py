"""Decontamination, BPE, language ID, LM scoring and toxicity: kernels against plain versions, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, entries, langid, lm, textbatch, toxicity

SF = "/root/testdata/sf0.001"
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOWER = {i: i + 32 for i in range(65, 91)}
#: Every kind of odd row: nulls, empty, no words, ties, repeats, very long.
ODD = [(1, None), (2, ""), (3, "  \n..."), (4, "a"), (4, "a"), (None, "null id"), (6, "Été, ÉTÉ 漢字 42"), (7, "x " * 30_000), (8, None)]


def plain_words(t):
    return re.findall(WORD, (t or "").translate(LOWER))


def odd(spark):
    """ODD with extra columns whose names clash with what the operators add."""
    names = "score string, n_words string, ids string, kept string, lang string, items string"
    return spark.createDataFrame([(*r, "s", "w", "i", "k", None, "t") for r in ODD], f"doc_id long, text string, {names}")


def empty(spark):
    return odd(spark).where("false")


def test_word_kernels():
    texts = [t for _, t in ODD]
    h, off = textbatch.word_hashes(pa.array(texts))
    expected = [[textbatch.hash_word(w.encode()) for w in plain_words(t)] for t in texts]
    assert [h[a:b].tolist() for a, b in zip(off, off[1:])] == expected


def plain_hits(text, items, n=10):
    w, hit, found = plain_words(text), set(), set()
    for i, t in items:
        x = plain_words(t)
        for k in range(max(1, len(x) - n + 1)) if x else ():
            g = x[k : k + n]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [3, 250_000])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(1)
    say = lambda k: " ".join(rng.choice(["ab", "c", "é", "ab-c", "D!"]) for _ in range(k))
    items = [(1, say(12)), (2, say(3)), (3, "b"), (4, None), (5, "..."), (None, say(11)), (10, say(30)), (3, "b")]
    docs = [(i, None if i % 17 == 0 else f"{say(rng.randint(0, 40))} {rng.choice(items)[1] or ''} {say(rng.randint(0, 40))}") for i in range(120)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.occurrences(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in got} == {i: plain_hits(t, items) for i, t in docs}
    assert all(r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in got)


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "x x x"), (2, None)], "item_id long, text string")
    got = decontaminate.occurrences(odd(spark), bench)
    assert got.count() == len(ODD) and got.where("contaminated").select("doc_id").collect()[0][0] == 7
    clean = decontaminate.clean_documents(odd(spark), bench)
    assert clean.columns == odd(spark).columns and clean.count() == len(ODD) - 1 and clean.where("score = 's' AND items = 't'").count() == len(ODD) - 1
    assert decontaminate.occurrences(empty(spark), bench).count() == 0
    assert decontaminate.occurrences(odd(spark), bench.where("false")).where("contaminated").count() == 0


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path(entries.VOCABULARY_FILE)
    ranks = bpe.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(" \n\tab1é'漢.s<|>▁") for _ in range(60)) for _ in range(500)] + ["<|endoftext|>", "a" * 3000, "don't  we'll\n\n x "]
    for blank_begins in (False, True):
        own = bpe.ByteBPE(bpe.serialise(ranks), P.PATTERN, blank_begins)
        for t, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
            assert own.decode(ids) == t.encode()
    got = bpe.encode_documents(odd(spark), path, P.PATTERN)
    assert got.count() == len(ODD) and got.where("NOT round_trip").count() == 0
    assert got.where("doc_id IN (1, 2)").select("n_tokens").distinct().collect()[0][0] == 0
    assert bpe.encode_documents(empty(spark), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\w+|\W", r"(\S)\s?|\s+", r" ?[a-z]+|[^a-z]"])
def test_bpe_with_other_patterns(pattern):
    """Patterns for which a blank begins no match, or with groups: as the library cuts them."""
    import public_tokenizers as P
    import tiktoken

    path = P.path(entries.VOCABULARY_FILE)
    ranks = bpe.read_ranks(path)
    own = bpe.ByteBPE(bpe.serialise(ranks), pattern)
    theirs = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["a bc  def, ghi 12 x", " x", "tab\tand é 漢字 " * 30, "a" * 500]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]
    assert max(map(len, own.kept), default=0) <= bpe.LONGEST


def test_bpe_cache_is_bounded(monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "KEPT", 50)
    own = bpe.ByteBPE(bpe.serialise(bpe.read_ranks(P.path(entries.VOCABULARY_FILE))), P.PATTERN)
    texts = [" ".join(f"w{i * j}" for j in range(9)) for i in range(100)]
    assert [own.decode(x).decode() for k in range(0, 100, 5) for x in own.encode(texts[k : k + 5])] == texts


def test_language_id(spark):
    got = entries.op3_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    joined = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert joined[0] > 0.95 and 0 <= joined[1] <= joined[2] <= 1
    assert {r.doc_id for r in got.where("held_out").collect()} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    model = langid.train(docs.select("doc_id", "text", "lang"))
    odd_ = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd(spark), model).collect()}
    assert {x[0] for x in odd_ if x[1] == "und"} == {1, 2, 3, 8} and all(x[2] == 0 for x in odd_ if x[1] == "und")
    kept = langid.known_language(odd(spark), model)
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} >= {None, 6}
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.train(odd(spark))
    assert {r.lang_pred for r in langid.predict(odd(spark), none).collect()} == {"und"}


def test_lm_prefers_its_language(spark):
    rng = random.Random(3)
    line = lambda: " ".join(x for _ in range(30) for x in rng.choice([("the", "cat", "sat"), ("a", "dog", "ran"), ("my", "bird", "flew")]))
    docs = spark.createDataFrame([(i, line()) for i in range(400)], "doc_id long, text string")
    net = lm.train(docs, vocabulary=9, buckets=2, rounds=6)
    good = line()
    shuffled = good.split()
    rng.shuffle(shuffled)
    rows = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame([(1, good), (2, " ".join(shuffled)), (3, None), (4, "")], "doc_id long, text string"), net).collect()}
    assert rows[1].log_prob > rows[2].log_prob + 20
    assert rows[1].mean_log_prob > -1.6  # a model of single words can't be better than ln(1/9) = -2.2
    assert (rows[3].n_words, rows[3].log_prob, rows[3].mean_log_prob) == (0, 0.0, None) == (rows[4].n_words, rows[4].log_prob, rows[4].mean_log_prob)
    assert lm.score_documents(odd(spark), net).count() == len(ODD)
    blank = lm.train(empty(spark))
    assert lm.score_documents(empty(spark), blank).count() == 0


def plain_segments(values):
    """All maximal scoring segments by their definition: recursively the best segment, then left and right of it."""
    best, at = 0, None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            s = sum(values[i:j])
            if s > best + 1e-9:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    move = lambda x, by: [(a + by, b + by, s) for a, b, s in x]
    return plain_segments(values[:i]) + [(i, j - 1, round(best, 6))] + move(plain_segments(values[j:]), j)


def test_maximal_scoring_segments():
    rng = random.Random(4)
    for _ in range(200):
        values = [rng.choice([-toxicity.DRIFT, -toxicity.DRIFT, 1.1, 0.7, -1.3, 2.03]) for _ in range(rng.randint(0, 14))]
        given = [(v, i) for i, v in enumerate(values) if v != -toxicity.DRIFT]
        got = toxicity.segments([v for v, _ in given], [i for _, i in given])
        assert [(a, b, round(s, 6)) for a, b, s in got] == plain_segments(values)


def test_toxicity(spark):
    rng = random.Random(5)
    text = lambda bad: " ".join(rng.choice(["idiot", "scum", "moronic"]) if bad and rng.random() < 0.2 else f"w{rng.randint(0, 400)}" for _ in range(60))
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = ~toxicity.held_out()
    model = toxicity.train(docs.select("doc_id", "text").where(learn), docs.select("doc_id", "toxic").where(learn))
    got = toxicity.scored(docs, model).where(toxicity.held_out())
    assert got.where("(predicted = 1) = (toxic = 1)").count() / got.count() > 0.98
    passage = got.where("toxic = 1").first().passages[0]
    assert any(w in passage.text for w in ("idiot", "scum", "moronic"))
    odd_ = toxicity.scored(odd(spark), model).collect()
    assert len(odd_) == len(ODD) and all(0 <= r.score <= 1 for r in odd_)
    none = toxicity.train(odd(spark), docs.where("false").select("doc_id", "toxic"))
    assert toxicity.scored(odd(spark), none).where("score > 0.1").count() == 0
    assert toxicity.scored(empty(spark), model).count() == 0


def test_lm_words_of_a_bucket_have_their_own_probability(spark):
    """With production parameters: frequent, rare, unseen and random words outside the vocabulary differ, whether broadcast or joined."""
    rng = random.Random(7)
    say = lambda: "".join(rng.choice(["ba", "ko", "ri", "ten", "mu"]) for _ in range(4))
    rare = sorted({say() for _ in range(600)})
    lines = [" ".join([*(f"top{k}" for k in rng.sample(range(lm.VOCABULARY), 40)), *rng.choices(rare, range(1, len(rare) + 1), k=6)]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    count = {}
    for w in " ".join(lines).split():
        count[w] = count.get(w, 0) + 1
    net = lm.train(docs)
    top = {bytes(w) for w in (x.encode() for x in sorted(count, key=lambda w: (-count[w], w))[: lm.VOCABULARY])}
    other = [w for w in count if w.encode() not in top]
    bucket = {w: int(net.ids(np.array([lm.hash_word(w.encode())], np.uint64))[0]) for w in other}
    assert min(bucket.values()) >= lm.VOCABULARY
    often = max(other, key=count.get)
    seldom = min((w for w in other if bucket[w] == bucket[often]), key=count.get)
    alike = lambda make: next(w for w in iter(make, None) if w not in count and int(net.ids(np.array([lm.hash_word(w.encode())], np.uint64))[0]) == bucket[often])
    unseen, noise = alike(lambda: say() + say()), alike(lambda: "".join(rng.choice("qxzjwv0987") for _ in range(12)))
    asked = spark.createDataFrame(list(enumerate([often, seldom, unseen, noise, f"{unseen} {unseen}", *lines[:20]])), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(asked, net).collect()}
    assert count[often] > count[seldom]
    assert got[0].log_prob > got[1].log_prob > got[2].log_prob > got[3].log_prob
    assert abs((got[0].log_prob - got[1].log_prob) - np.log((count[often] - 0.5) / (count[seldom] - 0.5))) < 0.05
    assert got[4].n_words == 2 and len(got) == asked.count()
    joined = lm.train(docs, head=3)
    assert joined.tail.count() > 0 and len(joined.rare.hashes) <= 3
    for r in lm.score_documents(asked, joined).collect():
        assert abs(r.log_prob - got[r.doc_id].log_prob) < 1e-2 * abs(r.log_prob)
    for b in set(bucket.values()):
        mine = [w for w in other if bucket[w] == b]
        total = sum(count[w] for w in mine)
        assert abs(net.rare.total[b - lm.VOCABULARY] - total) < 1e-9 and net.rare.distinct[b - lm.VOCABULARY] == len(mine)


@pytest.mark.parametrize("n_langs", [4, 3, 2])
def test_unlearned_languages_are_rejected(spark, n_langs):
    """Whatever the number of languages: other scripts, another language and random letters go, clean documents stay."""
    rng = random.Random(8)
    noise = lambda letters, n=1500: "".join(rng.choice(letters) for _ in range(n))
    az = "abcdefghijklmnopqrstuvwxyz"
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        noise(az + "  "), noise(az + az.upper() + "0123456789+/"), noise("0123456789abcdef"), noise(az, 40),
    ]
    langs = ["en", "fr", "de", "es"][:n_langs]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isin(langs))
    model = langid.train(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    asked = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    clean = docs.where(langid.held_out()).where("text rlike '\\\\p{L}'").select("doc_id", "text")
    kept = {r.doc_id for r in langid.known_language(clean.union(asked), model).collect()}
    assert {strange[-1 - i][:40] for i in kept if i < 0} == set()
    assert len(kept) >= 0.99 * clean.count()


def test_toxicity_drops_no_tokens(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "idiot scum moronic" if i % 2 else "plain kind words", i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "MAX_TOKENS", 3)
    with pytest.raises(ValueError, match="MAX_TOKENS"):
        toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_lm_trains_on_every_place_once(spark, rounds):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 97}" for j in range(i))) for i in range(60)], "doc_id long, text string").repartition(3)
    net = lm.Network([b"w0", b"w1"])
    dealt = lm.dealt(docs, net, 4)
    seen = [sum(r.n for r in lm._train_round(dealt, net, k, rounds).collect()) for k in range(rounds)]
    assert sum(seen) == sum(range(60)) and min(seen) > 0


def small_network():
    net = lm.Network([b"aa", b"bb", b"cc"], 2)
    for w in net.weights():
        w[...] = np.random.default_rng(w.size).normal(0, 0.4, w.shape)
    return net


def plain_log_probs(net, words):
    """ln P(class | 2 K neighbours) of every word, with loops over single numbers."""
    ids = [int(net.ids(np.array([lm.hash_word(w)], np.uint64))[0]) for w in words]
    out = []
    for i, own in enumerate(ids):
        x = [float(v) for d in range(-lm.K, lm.K + 1) if d for v in net.emb[ids[i + d] if 0 <= i + d < len(ids) else net.size]]
        h = [np.tanh(sum(a * float(b) for a, b in zip(x, net.w1[:, k])) + float(net.b1[k])) for k in range(lm.HIDDEN)]
        z = [sum(a * float(b) for a, b in zip(h, net.w2[:, c])) + float(net.b2[c]) for c in range(net.size)]
        out.append(z[own] - np.log(sum(np.exp(v) for v in z)))
    return out


def test_lm_scores_against_plain_loops():
    """Class probabilities from both sides, and the words' shares in their classes, summed by document."""
    net = small_network()
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(n)) for n in (0, 1, 5, 30)] + [None]
    n, lp, row, h, k, unseen = net.score(pa.array(texts, pa.string()))
    assert n.tolist() == [0, 1, 5, 30, 0]
    for t, got in zip(texts, lp):
        assert abs(got - sum(plain_log_probs(net, [w.encode() for w in (t or "").split()]))) < 1e-3
    want = sorted((i, lm.hash_word(w.encode()), (t or "").split().count(w)) for i, t in enumerate(texts) for w in {x for x in (t or "").split()} if w in ("dd", "ee", "ff"))
    assert sorted(zip(row.tolist(), h.tolist(), k.tolist())) == want


def test_lm_gradients_against_differences():
    net = small_network()
    rng = np.random.default_rng(3)
    context, target = rng.integers(0, net.size + 1, (7, 2 * lm.K)), rng.integers(0, net.size, 7)
    loss = lambda: -float(np.mean(net.log_probs(context, target)))
    for w in net.weights():
        w[...] = w  # float32 steps
    for w, g in zip(net.weights(), net.gradients(context, target)):
        flat, slope = w.reshape(-1), g.reshape(-1)
        for k in rng.choice(w.size, min(w.size, 12), replace=False):
            held = flat[k]
            flat[k] = held + 2e-2
            up = loss()
            flat[k] = held - 2e-2
            down = loss()
            flat[k] = held
            assert abs((up - down) / 4e-2 - slope[k]) < 2e-3


def test_lm_does_not_depend_on_the_layout(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(5, "w1 w2")] * 3, "doc_id long, text string")
    found = []
    for parts in (1, 7):
        laid = docs.repartition(parts)
        net = lm.train(laid, vocabulary=30, buckets=5, head=100, shard=1500)
        found.append((net.flat(), sorted((r.doc_id, r.n_words, r.log_prob) for r in lm.score_documents(laid, net).collect())))
    assert found[0][0] == found[1][0]
    # documents scored together share matrix products, which round differently
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(found[0][1], found[1][1]))


def test_every_language_is_learned(spark):
    """Many languages of few texts each: all have landmarks, weights and predictions."""
    pick = langid.pick_landmarks([f"l{i % 4}" for i in range(40)], 2)
    assert [sum(int(k) % 4 == lang for k in pick) for lang in range(4)] >= [langid.LEAST_LANDMARKS] * 4
    say = lambda k: " ".join(f"{hashlib.md5(str((k, j)).encode()).hexdigest()[:6]}" for j in range(40))
    docs = spark.createDataFrame([(k, say(k % 30), f"l{k % 30:02d}") for k in range(150)], "doc_id long, text string, lang string")
    model = langid.train(docs, landmarks=8)
    assert model.langs == [f"l{k:02d}" for k in range(30)] and model.landmarks.shape[1] == 120
    assert langid.predict(docs, model).where("lang = lang_pred").count() == 150


def plain_bins(text):
    """The bins of a text's byte n-grams, one by one."""
    low = bytes(x if re.match("[0-9a-z\x80-\xff]", chr(x)) else 32 for x in text.translate(LOWER).encode())
    out = set()
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            x = (int.from_bytes(low[i : i + n], "big") + (n << 24)) * 2654435761 % 2**32
            x = (x ^ x >> 15) * 2246822519 % 2**32
            out.add(x >> 18)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_language_scores_against_plain_kernels(spark, parts):
    """Kernels of sets, Nystroem features and ridge regression written out; the model doesn't depend on the layout."""
    rng = random.Random(8)
    say = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 30)))
    rows = [(i, say(("abcdefgh", "efghijkl", "Éàijklmn")[i % 3]), "xyz"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    sample = {(r.key, r.lang): bytes(r.bits) for r in langid.training_sample(docs, 20).collect()}
    text = {(r.key, r.lang): r.text for r in docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), "lang", "text").collect()}
    least = {lang: sorted(k for k, x in text if x == lang)[:20] for lang in "xyz"}
    assert set(sample) == {(k, lang) for lang in "xyz" for k in least[lang]}
    keys = sorted(sample)
    sets = [plain_bins(text[k]) for k in keys]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [sets[k] for k in langid.pick_landmarks([lang for _, lang in keys], 10)]
    value, vector = np.linalg.eigh([[kernel(a, b) for b in marks] for a in marks])
    phi = lambda t: np.append([sum(kernel(t, z) * v for z, v in zip(marks, vector[:, c])) / value[c] ** 0.5 for c in range(len(marks))], 1.0)
    x = np.array([phi(t) for t in sets])
    beta = np.linalg.inv(x.T @ x + langid.RIDGE * np.eye(x.shape[1])) @ x.T @ np.array([[1.0 if lang == own else -1.0 for lang in "xyz"] for _, own in keys])
    model = langid.train(docs, 20, 10)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for i, t, _ in rows:
        s = phi(plain_bins(t)) @ beta
        assert got[i][0] == "xyz"[int(s.argmax())] and abs(got[i][1] - min(max((s.max() + 1) / 2, 0), 1)) < 2e-3
    for k, lang in enumerate("xyz"):
        own = [a for a, (_, x) in zip(sets, keys) if x == lang]
        shares = [sum(sum(b in o for o in own) - 1 for b in a) / (len(own) - 1) / len(a) for a in own]
        assert abs(model.least[k] - langid.MARGIN * np.quantile(shares, langid.QUANTILE)) < 1e-6


def test_language_sample_is_bounded(spark):
    """Null ids, ids that all rows share and rows that repeat: bounded, and never empty."""
    texts = [(f"text {i} " + "abc " * (i % 7)) for i in range(3000)]
    for rows in ([(None, t) for t in texts], [(7, t) for t in texts], [(7, "the same")] * 2000 + [(8, "one more")]):
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
        n = langid.training_sample(docs, 50).count()
        assert n == min(50, len(set(rows)))
        model = langid.train(docs, 50)
        assert {r.lang_pred for r in langid.predict(docs.limit(20), model).collect()} == {"x"}


def test_toxicity_scores_against_plain_counts(spark):
    """Token counts by text, log-odds with the prior, the significant tokens and the parameters of the extreme-value law."""
    rng = random.Random(11)
    bad, good = ["idiotic", "scum", "vermin"], ["garden", "kind", "music", "paper", "sunday", "reading"]
    rows = [(i, " ".join([*rng.choices(good, k=rng.randint(2, 9)), *(rng.choices(bad, k=2) if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    counts = {}
    for _, t, y in rows:
        words = set(plain_words(t))
        for token in {(w, True) for w in words} | {(w[:n], False) for w in words for n in toxicity.PREFIXES if len(w) > n}:
            counts.setdefault(token, [0, 0])[y] += 1
    n0, n1 = (sum(c[y] for (_, whole), c in counts.items() if whole) for y in (0, 1))
    want = {}
    for (w, whole), (y0, y1) in counts.items():
        prior, total = toxicity.PRIOR * (y0 + y1), n0 + n1
        odds = lambda y, n: np.log((y + prior) / (n + toxicity.PRIOR * total - y - prior))  # noqa: B023, E731
        delta = odds(y1, n1) - odds(y0, n0)
        if y0 + y1 > 1 and abs(delta / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))) >= toxicity.Z:
            h = textbatch.hash_word(w.encode()) if whole else None
            want[(w, whole)] = (h, max(-toxicity.CAP, min(toxicity.CAP, delta)))
    assert len(model.hashes) == len(want) > 3
    of = dict(zip(model.hashes.tolist(), model.scores.tolist()))
    assert all(abs(of[h] - s) < 1e-9 for h, s in want.values() if h is not None)
    assert sorted(round(s, 6) for s in of.values()) == sorted(round(s, 6) for _, s in want.values())
    # lambda solves the expectation of exp(lambda S) = 1 over the words of clean text
    shares = {}
    for (w, whole), (_, s) in want.items():
        if whole:
            shares[round(s - toxicity.DRIFT, 3)] = shares.get(round(s - toxicity.DRIFT, 3), 0) + (counts[w, True][0] + 0.5) / n0
    rest = max(1 - sum(shares.values()), 1e-9)
    assert abs(rest * np.exp(-model.lam * toxicity.DRIFT) + sum(p * np.exp(model.lam * s) for s, p in shares.items()) - 1) < 1e-6

"""Dedup, repeats, packing, preference formatting and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import ODD, SF, empty, odd, plain_words
from tidemark.llm import bpe, entries, exact_dedup, near_dedup, packing, preference, repeats

LOWER = {i: i + 32 for i in range(65, 91)}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_groups(spark, digest_bytes):
    """With digests of one byte nearly all chunks collide, and only their contents tell them apart."""
    rng = random.Random(1)
    base = ["".join(rng.choice("aAbB é\n") for _ in range(rng.choice([0, 5, 3000, 9000]))) for _ in range(25)]
    rows = [(i, rng.choice(base) if i % 7 else None) for i in range(150)] + [(200, base[0].upper().replace("É", "é"))]
    norm = lambda t: (t or "").translate(LOWER)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = {i: (max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs_of(spark, rows), digest_bytes).collect()}
    assert got == want


def test_exact_odd_rows(spark):
    got = exact_dedup.exact_groups(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.keep_id for r in got if r.doc_id in (1, 2, 8)} == {8}
    kept = exact_dedup.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (True, None)]
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.deduplicate(empty(spark)).count() == 0


def plain_similarity(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y))


def plain_classes(rows):
    def shingles(t):
        w = plain_words(t)
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    s = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and find(a) != find(b) and (s[a] == s[b] or plain_similarity(s[a], s[b]) >= 0.8):
                parent[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    return {d: min(c) for c in classes.values() for d in c}


@pytest.mark.parametrize("settings", [{}, {"block": 400}])
def test_near_classes(spark, settings):
    """Copies with a few changed words around one text: the classes of all pairs, whatever the path that finds them."""
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(90)] for _ in range(4)]

    def near(b):
        w = list(base[b])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        return " ".join(w)

    rows = [(i, near(i % 4)) for i in range(70)] + [(i, " ".join(f"y{rng.randint(0, 3000)}" for _ in range(60))) for i in range(70, 90)] + [(90, "a b c"), (91, "A, b. c"), (92, "a b"), (93, "z " * 40), (94, "z " * 44)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs_of(spark, rows), **settings).collect()}
    assert got == plain_classes(rows)


def test_near_odd_rows(spark):
    got = near_dedup.near_classes(odd(spark)).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len(ODD) - 1
    kept = near_dedup.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 1
    assert near_dedup.near_classes(empty(spark)).count() == 0


def plain_repeats(rows, n):
    count = collections.Counter(b[p : p + n] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - n + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("large", [1000, 5])
def test_repeats(spark, large):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd é") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) + passage[rng.randint(0, 20) : rng.randint(40, 90)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "ab" * 300), (1004, "xyz"), (1005, "xyz")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in repeats.remove_repeats(docs_of(spark, rows), 40, 10, large).collect()}
    assert got == plain_repeats(rows, 40)


def plain_passages(rows, n, words):
    """The covered runs of at least so many words, in bytes."""
    count = collections.Counter(b[p : p + n] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - n + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        out[i] = [list(m.span()) for m in re.finditer(b"\1+", bytes(gone)) if len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", b[m.start() : m.end()])) >= words]
    return out


@pytest.mark.parametrize("large", [1000, 4])
def test_passages_shorter_than_what_is_removed(spark, large):
    rng = random.Random(12)
    say = lambda k: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5))) for _ in range(k))
    passages = [say(9) for _ in range(3)]
    rows = [(i, f"{say(rng.randint(0, 9))}. {rng.choice(passages)[rng.randint(0, 6):]}, {say(rng.randint(0, 9))}") for i in range(80)]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs_of(spark, rows), 60, 10, large, 24, 6).collect()}
    assert {i: r.passages for i, r in got.items()} == plain_passages(rows, 24, 6) and any(r.passages and not r.removed for r in got.values())
    assert {i: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for i, r in got.items()} == plain_repeats(rows, 60)


@pytest.mark.parametrize("n", [2, 5, 30, 200])
def test_cover_of_groups_of_any_size(n):
    """Interval by interval, with arrays, and by comparing all pairs."""
    rng = random.Random(n)
    for _ in range(10):
        sides = [["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(6)] for _ in range(2)]
        made = {(rng.choice(sides[0]) + rng.choice("xy"), "core" + rng.choice("xy") + rng.choice(sides[1])) for _ in range(n)}
        texts = [((a + b).encode(), len(a)) for a, b in sorted(made)]
        weights = [rng.choice([1, 1, 3]) for _ in texts]
        want: dict = {}
        for i, (x, p) in enumerate(texts):
            for j, (y, q) in enumerate(texts):
                if i != j or weights[i] > 1:
                    l = repeats.common(x[:p][::-1], y[:q][::-1])
                    r = repeats.common(x[p:], y[q:])
                    for k, length in enumerate((12, 8)):
                        if l + r >= length and r >= 4:
                            a, b = want.get((i, k), (0, 0))
                            want[i, k] = (max(a, l), max(b, r))
        for few in (1000, 0):
            assert repeats.cover([t for t, _ in texts], [p for _, p in texts], weights, (12, 8), 4, few) == want


def test_long_texts_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    rng = random.Random(4)
    long_ = "".join(rng.choice("abcdefgh") for _ in range(9000))
    rows = [(1, long_), (2, "".join(rng.choice("xyz") for _ in range(300)) + long_[4321:5678]), (3, long_[:450])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in repeats.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == plain_repeats(rows, 400)


def test_maximal_repeats_have_all_occurrences(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(rng.choice("uvwxyz") for _ in range(20 + i)) + passage + "".join(rng.choice("uvwxyz") for _ in range(15))) for i in range(6)]
    found = collections.defaultdict(set)
    for r in repeats.maximal_repeats(docs_of(spark, rows), 40, 10).collect():
        found[r["repeat"], r.n_bytes].add((int(r.doc_id), r.start))
    assert {(i, 20 + i) for i in range(6)} in [v for (_, n), v in found.items() if n == 60]


def plain_maximal(rows, n):
    """The places of every string of at least n bytes whose occurrences differ on both sides; borders differ from everything."""
    at = collections.defaultdict(list)
    for i, t in rows:
        for p in range(len(t)):
            for q in range(p + n, len(t) + 1):
                at[t[p:q]].append((i, p, t[p - 1] if p else (i, p), t[q] if q < len(t) else (i, q)))
    differ = lambda x, k: len({y[k] for y in x}) > 1
    return {(len(w), len(x), frozenset(y[:2] for y in x)) for w, x in at.items() if len(x) > 1 and differ(x, 2) and differ(x, 3)}


def test_maximal_repeats_of_any_length(spark):
    """Passages many times the least length, whole, cut and as whole texts, against all substrings."""
    rng = random.Random(9)
    say = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = say(260)
    texts = [say(15) + passage + say(10), say(3) + passage + say(20), passage, say(9) + passage[30:200] + say(8), passage[:110] + say(5) + passage[150:], say(50), say(30) + passage[90:125], passage]
    rows = list(enumerate(texts))
    found, size = collections.defaultdict(set), {}
    for r in repeats.maximal_repeats(docs_of(spark, rows), 24, 6).collect():
        found[r["repeat"]].add((int(r.doc_id), r.start))
        size[r["repeat"]] = (r.n_bytes, r.n)
    assert {(*size[k], frozenset(v)) for k, v in found.items()} == plain_maximal(rows, 24)


def test_repeats_odd_rows(spark):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(odd(spark)).collect()}
    assert (1, 0, 0) in got and (7, 60_000, 60_000) in got and len(got) == len(ODD) - 1
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        got = packing.best_fit_decreasing(sizes, 50)
        room, want = [], []  # the plain version looks at every open sequence
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [r for r in room if r >= sizes[i]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - sizes[i])
            else:
                want.append(i)
                room.append(50 - sizes[i])
        assert sorted(i for s in got for i in s) == list(range(len(sizes)))
        assert sorted(50 - sum(sizes[i] for i in s) for s in got) == sorted(room)


def test_packing_loses_nothing(spark):
    path, pattern = entries.vocabulary()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd(spark).where("doc_id IN (1, 2, 7)").selectExpr("doc_id + 100000", "text"))
    packed = packing.pack(docs, path, pattern, 512, 20_000).persist()
    for r in packed.collect():
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 512 and len(r.ids) == len(r.position_ids) == 4 * 512
    parts = collections.defaultdict(list)
    for r in packing.unpack(packed).collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    own = bpe.ByteBPE(bpe.serialise(bpe.read_ranks(path)), pattern)
    rows = docs.collect()
    want = {r.doc_id: ids for r, ids in zip(rows, own.encode([r.text or "" for r in rows])) if ids}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in parts.items()} == want


@pytest.mark.parametrize("kind", ["short", "decimal(20,2)", "double", "string", "date", "long"])
def test_packing_of_any_id(spark, kind):
    """Every type of doc_id, null ids, repeated rows, empty texts and clashing columns; nothing depends on the layout."""
    rows = [(i, f"text {i} " * (i % 50)) for i in range(120)] + [(5, "text 5 " * 5), (None, "no id"), (None, "no id"), (7, None), (8, "")]
    base = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, ids string, n_tokens int")
    base = base.withColumn("doc_id", F.date_add(F.lit("2020-01-01"), "doc_id") if kind == "date" else F.col("doc_id").cast(kind))
    found = []
    for parts in (1, 7):
        packed = packing.pack(base.repartition(parts), *entries.vocabulary(), 64, 500, 3000).persist()
        found.append(sorted(map(str, packed.collect())))
        assert packed.select("sequence_id").distinct().count() == len(found[-1]) and packed.schema["doc_ids"].dataType.elementType == base.schema["doc_id"].dataType
        whole = collections.Counter(r.doc_id for r in packing.unpack(packed).where("start = 0").collect())
        assert whole == collections.Counter(r.doc_id for r in base.where("text <> ''").collect())
    assert found[0] == found[1]
    assert packing.pack(base.where("false"), *entries.vocabulary()).count() == 0


def test_packed_table_is_written(spark, tmp_path):
    packed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), *entries.vocabulary())
    packing.write_packed(packed, str(tmp_path / "packed"))
    assert packing.unpack(spark.read.parquet(str(tmp_path / "packed"))).count() >= 190


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "more"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"),
        (2, 0, "system", "s"), (2, 1, None, None), (3, 0, "system", "s"), (3, 1, None, None),
        (4, 0, "user", "alone"), (None, 0, "user", "nobody"), (7, None, "user", "no turn"),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, prompt int")
    got = {r.pair_id: r for r in preference.format_pairs(table, preference.paired_by_id(table)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[0].prompt, got[0].n_common) == ("<|user|>\nhi\n", 1)
    assert got[0].chosen == "<|assistant|>\na\n<|user|>\nmore\n" and got[0].rejected == "<|assistant|>\nb\n"
    assert [(m.start, m.length, m.train) for m in got[0].chosen_mask] == [(0, 16, True), (16, 14, False)]
    assert got[1].n_common == 2 and got[1].chosen == got[1].rejected == "" and "<|unknown|>" in got[1].prompt
    assert got[2].prompt == "" and got[2].rejected == "" and got[2].chosen == "<|user|>\nalone\n"
    assert got[3].chosen == "" and got[3].rejected == "<|user|>\nno turn\n"
    assert preference.format_pairs(table.where("false"), preference.paired_by_id(table.where("false"))).count() == 0


def test_pipeline(spark):
    """The stages' decisions against plain versions of each, on what the stage before kept."""
    import corpus_pipeline

    from tests.llm.test_text_ops import plain_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(kept["language"]) >= 0.99 * len(first)
    largest = {}
    for i, t in kept["language"].items():
        largest[t.translate(LOWER)] = max(i, largest.get(t.translate(LOWER), -1))
    assert set(kept["exact"]) == set(largest.values())
    assert set(kept["near"]) == set(plain_classes(sorted(kept["exact"].items())).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(kept["benchmark"]) == {i for i, t in kept["near"].items() if not plain_hits(t, items)[1]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("round_trip").count() == len(kept["benchmark"])


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_pipeline_odd_rows(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(*r, None, None, None) for r in (ODD if rows == "odd" else [])], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i))
    # nothing is labelled, so no language is known; without that stage every text with its repeats stays once
    assert all(v == [] for v in kept.values())
    docs = spark.createDataFrame([(*r, None, None, None) for r in (ODD if rows == "odd" else [])], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF).persist()
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i))
    # 8 stays for the empty texts 1, 2 and 8, and one of the rows that repeat 4
    assert kept["exact"] == kept["near"] == kept["benchmark"] == kept["encode"] == ([3, 4, 6, 7, 8, None] if rows == "odd" else [])

"""The operators against brute-force versions on small inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import jaccard, sharding, substrings
from corpusmill.llm.common import prepare
from corpusmill.llm.grades import _scores, fitted_grades, grade, rating
from corpusmill.llm.grades import fit as grades_fit
from corpusmill.llm.graph import components
from corpusmill.llm.licenses import license_scan
from corpusmill.llm.neighbours import tile_neighbours
from corpusmill.llm.packing import WordIds, fill_rest, packing_plan
from corpusmill.llm.queries import QUERIES
from corpusmill.llm.sentencepiece import UNKNOWN, Automaton, Model
from corpusmill.llm.toxicity import CATEGORIES, features, fitted, labelled_sample, toxicity, toxicity_labels, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def _prepared(spark):
    prepare(spark)


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def test_quality_rules(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    for i, text in zip(texts.doc_id, texts.text):
        w = words(text)
        windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        times = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_rules_keep_clean_and_reject_junk(spark):
    judged = QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    clean, junk = (judged.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert clean > 0.99 and junk < 0.5


def test_sharding(spark, texts):
    rows = QUERIES["op4_sharding"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in zip(texts.doc_id, texts.text)}
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """A third of the rows are one row again and again, and many are tiny."""
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 50)
    rows = [(1, "same text")] * 1000 + [(i, "") for i in range(500)] + [(i, f"text {i} " * (i % 50)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = sharding.text_size(F.col("text"))
    keyed = sharding._keyed(df, F.xxhash64("text"), F.col("doc_id"), size)
    n, b = keyed.agg(F.count("*"), F.sum("_size")).first()
    found = sharding.splitters(keyed, 60, b, n)
    counts = [x[1] for x in sharding._sizes(keyed, found)]
    assert sum(counts) == n and max(counts) <= sharding.OVERFULL * n / 60 + 1
    out = sharding.shard_by_bytes(df, 5, F.xxhash64("text"), F.col("doc_id"), size).groupBy("shard").agg(
        F.count("*"), F.max("slot"), F.sum(size)).collect()
    assert sorted(r[0] for r in out) == list(range(5)) and all(r[1] == r[2] + 1 for r in out)
    assert max(r[3] for r in out) - min(r[3] for r in out) < 1000


def near_copies(seed: int, n: int = 60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 6, 9, 40, 150)))] for _ in range(12)]
    shared = [rng.choice(vocabulary) for _ in range(70)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w = w[:at] + shared[rng.randrange(10):] + w[at:]
        out.append((i, rng.choice((" ", "\n", " \t")).join(w)))
    return out


def brute_components(rows):
    sets = {i: ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
            for i, t in rows for w in [words(t.lower())]}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {(i, len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("seed, linear", [(1, 4), (2, 0), (3, 0)])
def test_jaccard_join(spark, monkeypatch, seed, linear):
    monkeypatch.setattr(jaccard, "LINEAR", linear)  # 0: list heads are drawn again
    rows = near_copies(seed)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


def test_join_keys_meet_for_every_similar_pair():
    """Whatever the boundary between light and heavy, similar sets share a key."""
    rng = np.random.default_rng(0)
    levels = rng.integers(0, 5, jaccard.CLASSES).astype(np.uint8)
    for _ in range(400):
        n = int(rng.integers(2, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 5 * common >= 4 * (len(a) + len(b) - common):
            boundary = int(rng.integers(0, 70))
            (x, at_x), (y, at_y) = (jaccard.join_keys(s, levels, boundary) for s in (a, b))
            need = -(-4 * (len(a) + len(b)) // 9)
            shared, i, j = np.intersect1d(x, y, return_indices=True)
            assert any(at_x[p] <= len(a) - need + 1 and at_y[q] <= len(b) - need + 1 for p, q in zip(i, j))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


@pytest.mark.parametrize("hot", [512, 1])
def test_substrings(spark, hot):
    rows = near_copies(7) + [(100, near_copies(7)[3][1]), (101, near_copies(7)[3][1])]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=8, mini=3, hot=hot)
    first: dict[bytes, int] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 7):
            x = b" ".join(w[k:k + 8])
            first[x] = min(i, first.get(x, i))
    want = set()
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 7) if first[b" ".join(w[k:k + 8])] < i for j in range(8)}
        want.add((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()} == want


def test_substrings_query(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_substring_dedup"](spark, SF).collect()}
    for i, t in zip(texts.doc_id, texts.text):
        if got[i][1] == 0:
            assert got[i] == (len(words(t)), 0, hashlib.sha256(b" ".join(words(t))).hexdigest())


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in zip(texts.doc_id, texts.text):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    rows = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    assert {tuple(r)[:5] for r in rows} == want
    by: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(places[-1]) <= 2048
    assert len(by) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048)


TRICKY = ["don't", "we'LL", "a,b", "the.", "12a", "É", "é", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>", "☃", " ", "\xa0",
          "\x1c", "ﬁ", "'s", "a'", "``", "_a", "🏽"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(TRICKY) | st.text(max_size=6), max_size=8), st.sampled_from([" ", "\n", "\t ", "\x0b", "\x0c", ""]))
def test_word_ids_are_those_of_the_whole_text(parts, joint):
    text = joint.join(parts).encode("utf-8", "ignore").decode()
    want = TOKENIZER.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(TOKENIZER.of([text.encode()])[0], dtype="<u4").tolist() == want


TOKENIZER = WordIds(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("low, high, n", [(600, 1100, 4000), (1, 60, 900), (300, 2047, 3000)])
def test_plan_uses_all_pieces_and_is_no_worse_than_best_fit(low, high, n):
    counts = np.bincount(np.random.default_rng(1).integers(low, high, n), minlength=2049)
    plan, bound = packing_plan(counts)
    used = np.zeros_like(counts)
    for filling, times in plan:
        assert sum(a * b for a, b in filling) <= 2048
        for a, b in filling:
            used[a] += b * times
    assert (used == counts).all()
    total = sum(t for _, t in plan)
    assert bound <= total + 1e-6 and total <= sum(t for _, t in fill_rest(counts, 2048))


def test_neighbours(spark):
    got = [tuple(r) for r in QUERIES["op9_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect()]
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    x, ids = np.stack(table.embedding.values).astype(float), table.vec_id.values
    want = []
    for q in sorted(i for i in ids if i % 100 == 0):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        want += [(q, r + 1, ids[k], d[k]) for r, k in enumerate(order)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_tiles_lose_no_neighbour(scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16)) * scale
    y = centres[rng.integers(0, 5, 3000)] + rng.normal(size=(3000, 16)) * scale * 1e-3
    ids = np.arange(3000)
    found = tile_neighbours(ids[:20], y[:20], ids, y, 10)
    for i in range(20):
        d = np.sqrt(((y - y[i]) ** 2).sum(axis=1))
        assert [other for _, other in found[i]] == [k for k in np.lexsort((ids, d)) if k != i][:10]


MODEL = Model(public_tokenizers.path("piece_bpe_32k.model"))


def best_score(text: str, pieces: dict[str, float], unknown: float) -> float:
    best = [0.0] + [-np.inf] * len(text)
    longest = max(map(len, pieces), default=1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            score = pieces.get(text[start:end], unknown if end - start == 1 else -np.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc▁", max_size=25), st.dictionaries(st.text(alphabet="abc▁", min_size=1, max_size=4), st.integers(-30, 0), max_size=12))
def test_viterbi_finds_the_best_score(text, scores):
    pieces = {p: float(s) for p, s in scores.items()}
    unknown = min(pieces.values(), default=0.0) - UNKNOWN
    automaton = Automaton([(p, i, s) for i, (p, s) in enumerate(pieces.items())])
    score, found = automaton.viterbi(text, unknown)
    assert score == best_score(text, pieces, unknown) and "".join(c for _, c in found) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_decoding_gives_the_text_back(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, _ = MODEL.encode(text)
    assert MODEL.decode(np.frombuffer(ids, dtype="<i4")) == text


def test_words_are_encoded_as_in_the_whole_text(texts):
    pieces = {p: s for p, s, kind in MODEL.pieces if kind in (1, 4)}
    for text in texts.text[:15]:
        line = text.split("\n")[0][:300]
        assert MODEL.encode(line)[1] == pytest.approx(best_score("▁" + line.replace(" ", "▁"), pieces, MODEL.unknown))


def test_licenses(spark):
    rows = [(1, "Text.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. You may not use "
            "this file except in compliance with the License."), (3, "no licence here, MIT License is only named"),
            (4, "All rights reserved. LICENSED UNDER CC BY-NC 4.0!"), (5, "This program is free software; you can redistribute it "
            "and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
            "version 3 of the License, or (at your option) any later version.")]
    got = {r["doc_id"]: r["licenses"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ["MIT"] and got[2] == ["Apache-2.0"] and got[3] == [] and got[4] == ["CC-BY-NC-4.0", "Proprietary"]


def test_features_stand_out_as_counted_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = toxicity_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    numbers, values, vocabulary = labelled_sample(docs, labels, CATEGORIES)
    rows = docs.join(labels, "doc_id").toPandas()
    sets = [features(words_of(t)) for t in rows.text]
    total = Counter(w for s in sets for w in s)
    wanted = set()
    for c in CATEGORIES:
        hits = [s for s, y in zip(sets, rows[c], strict=True) if y == 1]
        for w, k in Counter(w for s in hits for w in s).items():
            share = total[w] / len(sets)
            expected = len(hits) * share
            if total[w] >= 3 and k > 2 * expected and k - expected > 3 * (expected * (1 - share) + 1e-9) ** 0.5:
                wanted.add(w)
    assert vocabulary == sorted(wanted) and len(numbers) == len(values) == len(rows)
    assert Counter(vocabulary[i] for n in numbers for i in n) == {w: total[w] for w in wanted}


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0
    chain = fitted(docs, labels.where(~held))
    got = toxicity(docs.join(labels.where(held), "doc_id"), chain).select("toxic", "is_toxic").toPandas()
    truth = got.toxic == 1
    assert len(got) > 1000 and got.is_toxic[truth].mean() > 0.9 and got.is_toxic[~truth].mean() < 0.02


def test_held_out_grades(spark):
    """Fitted on two thirds of the ratings, each grade is found again in the rest, and expected grades rise with them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality is not null")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0
    model = fitted_grades(docs, labels.where(~held))
    got = grade(docs.join(labels.where(held), "doc_id"), model).toPandas()
    truth = np.array([rating(t.encode(), q) for t, q in zip(got.text, got.quality, strict=True)])
    guess = np.clip(np.rint(got.expected_grade), 0, 2)
    recalls = [float((guess[truth == g] == g).mean()) for g in range(3)]
    print("held-out recall by grade", recalls, "rows", [int((truth == g).sum()) for g in range(3)],
          "kept of good and poor", got.kept[truth == 2].mean(), got.kept[truth < 2].mean())
    assert len(got) > 1000 and recalls[2] > 0.97 and min(recalls[:2]) > 0.4
    assert got.kept[truth == 2].mean() > 0.97 and got.kept[truth < 2].mean() < 0.2
    means = [got.expected_grade[truth == g].mean() for g in range(3)]
    assert means == sorted(means)


def test_grades_gradient_by_finite_differences():
    """One step of the fit moves thresholds and weights down the likelihood's slope, whose value is taken by differences."""
    texts = [b"alpha beta", b"beta gamma gamma", b"delta", b"alpha delta", b"gamma"]
    ratings = np.array([0, 1, 2, 1, 0])
    few, many = (grades_fit(texts, ratings, 3, rounds=r) for r in (1, 400))

    def loss(model):
        up = model.above(_scores(model, texts, {}))
        full = np.column_stack([np.ones(len(texts)), up, np.zeros(len(texts))])
        return -np.log(full[np.arange(5), ratings] - full[np.arange(5), ratings + 1]).mean()

    start = grades_fit(texts, ratings, 3, rounds=0)
    assert loss(start) > loss(few) > loss(many)
    assert (np.diff(many.thresholds) > 0).all()
    guess = many.above(_scores(many, texts, {})).sum(axis=1)
    assert np.argsort(guess, kind="stable")[-1] == 2 and abs(guess[2] - 2) < 0.5
    for k in range(2):  # no small move of a threshold does better than the fit by much
        for d in (-0.05, 0.05):
            moved = many.thresholds.copy()
            moved[k] += d
            assert loss(type(many)(many.weights, moved)) > loss(many) - 1e-3


def test_pipeline(spark):
    """Every stage works on what its predecessor kept; the pieces cover exactly the documents left."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.spool(stage(spark, docs, SF), "stage")
        counts.append(docs.select("doc_id").distinct().count())
    assert counts[0] > counts[1] > counts[2] > counts[3] >= counts[4] == counts[5]

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import hmm
from corpusmill.llm.common import prepare


def some_model(symbols=7, states=3, seed=4):
    lots = np.random.default_rng(seed)
    emit = lots.random((symbols, states)) + 0.05
    move = lots.random((states, states)) + 0.1
    start = lots.random(states)
    return hmm.Model(start / start.sum(), move / move.sum(axis=1)[:, None], emit / emit.sum(axis=0))


def some_texts(model, lengths, seed=5):
    lots = np.random.default_rng(seed)
    return [lots.integers(0, len(model.emit), n).astype(np.uint16) for n in lengths]


def over_all_paths(model, text):
    """(probability, expected starts, moves and emissions) by summing over every sequence of states."""
    total = 0.0
    found = hmm.Expected.none(*model.emit.shape)
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
        total += p
        found.start[path[0]] += p
        for t, s in enumerate(path):
            found.emit[text[t], s] += p
            if t:
                found.move[path[t - 1], s] += p
    return total, hmm.Expected(found.start / total, found.move / total, found.emit / total)


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_recursions_equal_the_sum_over_all_paths(monkeypatch, block):
    monkeypatch.setattr(hmm, "BLOCK", block)
    monkeypatch.setattr(hmm, "GROUP", 5)
    model = some_model()
    texts = some_texts(model, (1, 2, 3, 4, 6, 7, 1))
    logs = hmm.log_probabilities(model, texts)
    into = hmm.Expected.none(*model.emit.shape)
    hmm.count_texts(model, texts, into)
    wanted = hmm.Expected.none(*model.emit.shape)
    for text, log in zip(texts, logs, strict=True):
        p, counts = over_all_paths(model, text)
        assert log == pytest.approx(math.log(p), rel=1e-10)
        for name in ("start", "move", "emit"):
            getattr(wanted, name)[:] += getattr(counts, name)
    assert np.allclose(into.start, wanted.start)
    assert np.allclose(into.move * model.move, wanted.move)
    assert np.allclose(into.emit, wanted.emit)


def test_long_texts_in_blocks_equal_one_run():
    model = some_model(50, 5)
    texts = some_texts(model, (9_000, 3, 2_048, 2_049, 4_096))
    state, total = model.start, 0.0
    for t, symbol in enumerate(texts[0]):
        state = (state @ model.move if t else state) * model.emit[symbol]
        total += math.log(state.sum())
        state = state / state.sum()
    assert hmm.log_probabilities(model, texts)[0] == pytest.approx(total, rel=1e-10)
    into = hmm.Expected.none(50, 5)
    hmm.count_texts(model, texts, into)
    assert into.emit.sum() == pytest.approx(sum(map(len, texts)))
    assert (into.move * model.move).sum() == pytest.approx(sum(len(t) - 1 for t in texts))


def test_training_never_lowers_the_likelihood(monkeypatch):
    monkeypatch.setattr(hmm, "MIXED", 0.0)
    monkeypatch.setattr(hmm, "ADDED", 0.0)
    tokens = np.full(7, 10.0)
    model = hmm.first_model(tokens, 3)
    texts = some_texts(model, [40] * 10)
    before = -math.inf
    for _ in range(8):
        now = hmm.log_probabilities(model, texts).sum()
        assert now >= before - 1e-9
        before = now
        found = hmm.Expected.none(7, 3)
        hmm.count_texts(model, texts, found)
        model = hmm.next_model(model, found, tokens)


def corpus(spark):
    texts = [None, "", "One two  TWO\tthree", "Ä ä É", "x" * 5000, "a\x0bb\x0cc", "one " * 3000] * 6 + ["only here " + str(i) for i in range(30)]
    return spark.createDataFrame([(i, t, "kept", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, note string, score double")


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_counts_and_base_scores_by_hand(spark):
    prepare(spark)
    docs = corpus(spark)
    got = hmm.lm_scores(docs, states=3, rounds=2, common=4)
    assert got.columns == ["doc_id", "note", *hmm.RESULTS]
    texts = {r["doc_id"]: hmm.words_of((r["text"] or "").encode()) for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if not is_held(i) for w in [*t, "end"])
    total, distinct = sum(counts.values()), len(counts)
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        words = [*texts[r["doc_id"]], "end"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (is_held(r["doc_id"]), len(words), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert {r["held_out"] for r in rows} == {True, False}


def test_words_of_a_class_share_it_by_their_counts(spark):
    """One-word texts of a class differ by their word's count alone; a class's known and one unknown word have all of it."""
    prepare(spark)
    same = ["aXYZ", "bbXYZ", "cXYZ", "unseenXYZ", "XYZ"]
    times = {"axyz": 3, "bbxyz": 1, "cxyz": 7, "xyz": 2}
    texts = ["often " * 9 + " ".join(" ".join([w] * n) for w, n in times.items())]
    free = next(i for i in range(99) if not is_held(i))
    held = [i for i in range(100) if is_held(i)]
    docs = spark.createDataFrame([(free, texts[0]), *zip(held, [*same, ""])], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in hmm.lm_scores(docs, states=2, rounds=2, common=1).collect()}
    scores = dict(zip([w.lower() for w in same], (found[i] for i in held)))
    for word in scores:
        assert scores[word] - scores["xyz"] == pytest.approx(math.log10((times.get(word, 0) + 0.5) / 2.5))
    assert len({hmm.class_of(w.lower().encode()) for w in same}) == 1


def test_beats_single_tokens_on_held_out_texts(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.lm_scores(docs.select("doc_id", "text")).where("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert got[0] > 0.96 * got[1] and got[2] > 0.9


def test_empty_tables_null_ids_and_text_ids(spark):
    prepare(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.lm_scores(none, states=2, rounds=1).collect() == []
    rows = spark.createDataFrame([(None, "a b"), ("x", "a"), ("x", "a")], "doc_id string, text string")
    got = hmm.lm_scores(rows, states=2, rounds=1).collect()
    assert len(got) == 3 and all(r["n_tokens"] in (2, 3) for r in got)
    only_held = spark.createDataFrame([(next(i for i in range(99) if is_held(i)), "a b")], "doc_id long, text string")
    row = hmm.lm_scores(only_held, states=2, rounds=1).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0) and row["score"] < 0

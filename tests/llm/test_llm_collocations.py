from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import collocations as col
from corpusmill.llm.collocations import collocations, phrase_counts, with_score
from corpusmill.llm.common import prepare
from corpusmill.llm.transducers import CountTransducer, acceptor

paths_ = st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"\x01", b"aa", b"\xc3\xa9"]), min_size=1, max_size=4).map(tuple), max_size=60)


def transducer(paths):
    words = sorted({w for p in paths for w in p})
    rows = np.array([[words.index(w) + 1 for w in p] + [0] * (4 - len(p)) for p in paths], dtype=np.int32).reshape(-1, 4)
    return CountTransducer.build(words, rows, np.ones(len(rows), dtype=np.int64))


def contents(t):
    ends = np.flatnonzero(t.ends)
    return dict(zip(t.named(ends), t.ends[ends].tolist(), strict=True))


@settings(max_examples=150, deadline=None)
@given(paths_, paths_, paths_)
def test_transducers_count_unite_cut_and_compose(first, second, borders):
    t = transducer(first)
    assert contents(t) == Counter(first)
    states = np.arange(len(t.word))
    prefixes = t.named(states)
    assert len(set(prefixes)) == len(prefixes) and prefixes == sorted(prefixes)
    for prefix, weight in zip(prefixes, t.weights().tolist(), strict=True):
        assert weight == sum(p[:len(prefix)] == prefix for p in first)
    back = CountTransducer.unpacked(t.packed())
    assert contents(back) == contents(t)
    whole = CountTransducer.union([t, transducer(second)], 4)
    assert contents(whole) == Counter(first + second)
    borders = sorted(set(borders))
    parts = whole.cut(borders)
    assert sum((Counter(contents(p)) for _, p in parts), Counter()) == Counter(first + second)
    for number, part in parts:
        for path in contents(part):
            assert sum(b <= path for b in borders) == number
    asked, at = acceptor(borders, 4)
    reached = whole.composed(asked)[at] if borders else []
    for path, state in zip(borders, reached, strict=True):
        there = any(p[:len(path)] == path for p in first + second)
        assert (state >= 0) == there and (not there or whole.named(np.array([state]))[0] == path)


def by_hand(rows, least, top, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = (q for q, b in f.items() if b >= least and len(q) > len(p) and 100 * b >= 100 * a)
            if any(q[i:i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed):
    lots = np.random.default_rng(seed)
    words = ["the", "THE", "a", "é", "É", "new", "york", "x\x01", "日本", "z" * 300, "of"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]
    rows = []
    for _ in range(120):
        text = "".join(words[lots.integers(len(words))] + marks[lots.integers(len(marks))] for _ in range(lots.integers(0, 40)))
        rows.append((["en", "fr", None, "und", ""][lots.integers(5)], text))
    return rows + [("en", None), ("en", ""), ("en", "the new york of " * 200), *[("fr", "same copy of a text")] * 40]


@pytest.mark.parametrize(("seed", "least", "per_range"), [(1, 4, 10**6), (2, 5, 40), (3, 30, 7)])
def test_rows_by_hand(spark, monkeypatch, seed, least, per_range):
    prepare(spark)
    for name in ("WINDOWS_PER_RANGE", "ASKED_PER_RANGE"):
        monkeypatch.setattr(col, name, per_range)
    monkeypatch.setattr(col, "AT_ONCE", 400)
    rows = corpus(seed)
    docs = spark.createDataFrame([(lang, text, 1, 2) for lang, text in rows], "lang string, text string, n int, score int").repartition(5)
    got = sorted(tuple(r) for r in collocations(docs, least=least, top=25).collect())
    assert got == by_hand(rows, least, 25) and got


def test_prefix_over_many_ranges_is_added_up(spark, monkeypatch):
    """One first word of a third of all windows: no range holds it alone, its counts are whole."""
    prepare(spark)
    monkeypatch.setattr(col, "WINDOWS_PER_RANGE", 5)
    texts = [f"hot w{i % 9} w{i % 7} w{i % 5}. hot hot" for i in range(300)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    counts = {r["phrase"]: r["a"] for r in phrase_counts(docs, least=3)[0].collect()}
    wanted = Counter()
    for t in texts:
        for piece in t.split("."):
            w = piece.split()
            for m in range(1, 6):
                wanted.update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    assert counts == {p: n for p, n in wanted.items() if n >= 3}


def test_scores_beyond_64_bits(spark):
    big = [(3_000_000_007, 9_000_000_000_011, 3_100_000_003, 3_300_000_001), (10**11 + 3, 10**13 + 7, 10**11 + 3, 10**11 + 9), (100, 10**13, 100, 100)]
    got = with_score(spark.createDataFrame(big, "a long, n long, l long, r long")).collect()
    assert [r["score"] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in big]


def test_no_rows_and_no_columns(spark):
    prepare(spark)
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations(spark.createDataFrame([(1,)], "doc_id int")).collect() == []
    one = spark.createDataFrame([("it is " * 150,)], "text string")
    assert [tuple(r)[:3] for r in collocations(one).collect()][0][0] == "und"

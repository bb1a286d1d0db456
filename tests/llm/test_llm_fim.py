from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm.common import prepare
from corpusmill.llm.fim import ERROR, RankIndex, fill_in_middle, rearranged, restored

MARKS = (b"<P>", b"<S>", b"<M>")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aä€😀 \n", max_size=400), st.integers(1, 900))
def test_index_gives_every_boundary(text, times):
    text = text * (times if len(text) < 40 else 1)
    index = RankIndex(text.encode())
    places = [0]
    for c in text:
        places.append(places[-1] + len(c.encode()))
    assert index.characters == len(text)
    assert [index.place(k) for k in range(len(text) + 1)] == places
    assert all(abs(index.predicted(k) - places[k]) <= ERROR for k in range(len(text) + 1))


def test_index_of_long_texts_is_small_and_exact():
    plain = RankIndex(b"x" * 3_000_000)
    assert len(plain.slope) == 1 and plain.residuals is None and plain.place(2_999_999) == 2_999_999
    mixed = "ab€" * 200_000 + "c" * 700_000 + "😀ß" * 150_000
    index = RankIndex(mixed.encode())
    assert len(index.slope) < 50
    for k in (0, 1, 599_999, 600_000, 1_300_000, 1_300_001, len(mixed) - 1, len(mixed)):
        assert index.place(k) == len(mixed[:k].encode())


def by_hand(key, text):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    x, y = sorted((a % (n + 1), b % (n + 1)))
    if d % 100 < 20:
        return n, "spm", x, y - x, f"<S>{text[y:]}<P>{text[:x]}<M>{text[x:y]}"
    return n, "psm", x, y - x, f"<P>{text[:x]}<S>{text[y:]}<M>{text[x:y]}"


def test_rows_by_hand_and_back(spark):
    prepare(spark)
    texts = [None, "", "a", "<P", "x <S> y", "naïve café 😀", "é" * 50, "日本語\n" * 99, "long " * 50_000, "<<M", "<P><S"] * 20
    docs = spark.createDataFrame([(i if i != 7 else None, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, n int, output int")
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i if i != 7 else None]
        assert tuple(r)[2:7] == by_hand(r["doc_id"], text)
        assert r["back"] == (text or "")
    assert {r["form"] for r in rows.values()} == {"plain", "psm", "spm"}


def test_text_ids_missing_columns_and_no_rows(spark):
    prepare(spark)
    named = spark.createDataFrame([("x-1", "some words here")] * 2, "doc_id string, text string")
    assert [tuple(r)[2:] for r in fill_in_middle(named).collect()] == [by_hand("x-1", "some words here")] * 2
    assert fill_in_middle(named.limit(0)).collect() == []
    assert fill_in_middle(named.drop("text")).first()["output"] == ""


def test_rates(spark):
    assert rearranged(b"abc", (0, 0, 90, 0), MARKS)[1] == "plain"
    assert rearranged(b"abc", (0, 0, 89, 20), MARKS)[1] == "psm"
    assert rearranged(b"abc", (1, 2, 89, 19), MARKS)[4] == b"<S>c<P>a<M>b"
    assert rearranged(b"abc", (1, 2, 95, 19), MARKS, rate=100, suffix_first=0)[4] == b"<P>a<S>c<M>b"

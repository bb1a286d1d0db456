from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpusmill.functions import html as hx
from corpusmill.operators import pages as pg


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("html,text", [
    ('<p>a<script>var t="</p><b>x</b>";</script>b</p>', "ab"), ("a<!-- <b>no</b> -->b", "ab"),
    ("<style>p{}</style><P>A &amp;lt; B</P>", "A &lt; B"), ("1 < 2 &copy; &#233;&#xE9; &#99999999; &unknown; &", "1 < 2 © éé &#99999999; &unknown; &"),
    ('<a title="x>y">z</a>', "z"), ("<a title='x>\"y'>z<IMG ALT = \"a>b\"/>w", "zw"), ("<p don't>a</p> it's <b>b", "a it's b"),
    ('<a title="never>ends', "ends"), ("<a b=c'd>e", "e"), ('<script x="a>b">hidden</script>c<?pi x?>', "c"), ("a<b", "a<b"),
    ("<!DOCTYPE html><html>x</html>", "x"), ("<script>open", ""), ("", ""), (None, None)])
def test_page_text(spark, html, text):
    assert one(spark, html, hx.page_text) == text


def titles(spark, html):
    return pg.page_titles(spark.createDataFrame([(html,)], "html string")).first()


def test_titles(spark):
    r = titles(spark, '<head><title> A <i>b</i> title </title><meta content="some words" name="description">'
                      "<meta property='og:title' content='Own title'></head><h1>Single</h1><b>bold text<br>more<p>x")
    assert (r["title"], r["meta_description"], r["og_title"], r["first_h1"], r["first_b"]) == (
        "Abtitle", "some words", "Own title", "Single", "bold text")
    assert r["page_title"] == "some words - Own title - bold text"


@pytest.mark.parametrize("html, name, text", [
    ("<div><h1>a<i>b</i> c<hr></div>d</h1>", "h1", "abc"), ("<h1>a<h1>b</h1>c</h1>d", "h1", "abc"), ("<h1 x='>'>a</H1 >b", "h1", "a"),
    ("</div><h1>a</i></h1>", "h1", "a"), ("<h1/>b<h1>c", "h1", ""), ("<p>none", "h1", None), ("<h1>a<script><h1>x</h1></script>b", "h1", "ab"),
    ("<u><h1>a &amp;<br> b ", "h1", "a &b"), (None, "h1", None), ("", "h1", None)])
def test_elements_end_with_the_stack(spark, html, name, text):
    assert one(spark, html, lambda c: hx.element_text(hx.tokens(c), name)) == text


def test_attributes_are_a_map(spark):
    tag = """<META Name="a>b" content='x "y" = z' name=last empty data-x = "1&amp;2" bare=q/>"""
    assert one(spark, tag, hx.attributes) == {"name": "last", "content": 'x "y" = z', "data-x": "1&2", "bare": "q/"}


@pytest.mark.parametrize("html", ['<a b="c', "<" * 50, "<a " + "x=" * 5000, '<a x="' * 300, "text", "<p>" * 400 + "<b>x"])
def test_tokens_are_lossless_and_quick(spark, html):
    assert "".join(one(spark, html, hx.tokens)) == html


def test_no_titles_give_null(spark):
    r = titles(spark, '<meta name="description"><h1></h1><script><title>no</title></script><!-- <b>x y</b> -->')
    assert r["title"] is None and r["meta_description"] is None and r["first_b"] is None and r["first_h1"] == ""
    assert r["page_title"] is None


def scan(spark, url_lists, pages, keywords, terms):
    lists = spark.createDataFrame(url_lists, "identifier long, urls string")
    return lists, pg.page_scan(lists, spark.createDataFrame(pages, "url string, html string"), keywords, terms)


def test_scan_counts_each_page_once_and_git_urls_every_time(spark):
    lists, found = scan(
        spark, [(1, "http://a http://git/x"), (2, "http://a http://git/x http://gone"), (3, None), (4, "http://b http://c http://d")],
        [("http://a", "code code python"), ("http://b", "nothing here, python"), ("http://c", "code and script, python"),
         ("http://d", "code alone"), ("http://unlisted", "code code code"), ("http://git/x", "code code code")],
        ("code", "script", "big data"), ("python", "c++"))
    got = {r["url"]: (r["keyword_total"], r["extension_total"]) for r in found.collect()}
    # http://b: all keywords are zero, the first one wins and is not a token, so python is not counted.
    assert got == {"http://a": (2, 1), "http://b": (0, 0), "http://c": (2, 1), "http://d": (1, 0)}
    assert rows(pg.true_positive_urls(found).select("url")) == [("http://a",), ("http://c",)]
    assert tuple(pg.search_summary(lists, found).first()) == (2, 3, 2)
    assert rows(pg.count_per_keyword(found, ("code", "script", "big data"))) == [("big data", 0), ("code", 4), ("script", 1)]


def test_keywords_of_two_words_are_counted_as_whole_words(spark):
    pages = spark.createDataFrame([("u", "Big data, big  data; big data set, bigdata")], "url string, html string")
    assert rows(pg.keyword_counts(pages, ("big data", "set"))) == [("u", "big data", 0, 2), ("u", "set", 1, 1)]


def test_ties_go_to_the_earlier_keyword(spark):
    pages = spark.createDataFrame([("u", "b a"), ("v", "")], "url string, html string")
    assert rows(pg.top_keyword(pg.keyword_counts(pages, ("a", "b")))) == [("u", "a"), ("v", "a")]

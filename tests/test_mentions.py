from __future__ import annotations

from conftest import rows
from corpusmill.operators import mentions as mt

SCHEMA = "identifier string, title string, description string, category string, link string, creator string, dates string"


def papers(spark, *items):
    return spark.createDataFrame([(i, t, d, c, "l", "c", "2019") for i, t, d, c in items], SCHEMA)


def test_code_sentences_without_a_url_are_discarded(spark):
    rows_in = papers(
        spark, ("1", "all", "The code is here. See http://a.org/b Keywords: x, y;", "q"),
        ("2", "no header", "The code is here. See http://a.org/b", "q"), ("3", "url only", "decoded http://a.org/b", "q"),
        ("4", "no url", "The code is here. Keywords: x;", "q"), ("5", "gate by comment", "text;Comment: code", "q"),
        ("6", "closed gate", "Software. http://a.org", "q"), ("7", "null", None, "q"))
    got = {r["title"]: (r["keywords"], r["mentioned_software"], r["urls"]) for r in mt.code_mentions(rows_in).collect()}
    assert got == {
        "all": ("x, y", ["The code is here."], ["http://a.org/b"]),
        "no header": ("", ["The code is here."], ["http://a.org/b"]),
        "url only": ("", [], ["http://a.org/b"]), "no url": ("", [], []), "gate by comment": ("", [], [])}


def test_cross_check_takes_first_url_and_drops_old_ids(spark):
    found = mt.cross_check_mentions(
        papers(spark, ("10", "a", "The code is here. Keywords: x, y;", "q"), ("astro/11", "b", "code.", "q"),
               ("12", "c", "plain words only", None), ("13", "d", "not listed", "q"), ("14", "e", None, "q")),
        spark.createDataFrame([("10", "first", 1), ("10", "second", 2), ("11", "u", 3), ("12", "", 4), ("bad", "u", 5),
                               ("14", "u", 6)], "identifier string, url string, seq long"))
    got = {r["identifier"]: r for r in found.collect()}
    assert set(got) == {10, 12}
    assert got[10]["urls"] == "first" and got[10]["keywords"] == ["x, y"]
    assert got[12]["urls"] == "" and got[12]["mentioned_software"] == []
    assert got[12]["keywords"] == ["plain words"]  # "only" is a stop word; what the phrase holds is dropped


def test_regex_dots_are_wildcards_and_null_does_not_match(spark):
    p = papers(spark, ("1", "a", "H-E-S-S- data", "physics:astro-ph"), ("2", "b", None, "physics:astro-ph"),
               ("3", "c", "H.E.S.S. data", None), ("4", "d", "H.E.S.S. data", "physics:astro-ph"))
    assert rows(mt.filter_regex(p).select("identifier")) == [("1",), ("4",)]
    assert rows(mt.filter_regex(p, literal=True).select("identifier")) == [("4",)]


def test_rows_with_a_null_part_are_skipped_whole(spark):
    p = papers(spark, ("1", "a", "x", "q"), ("2", None, "x", "q"), ("3", "c", None, "q"))
    assert rows(mt.source_line(p).select("identifier")) == [("1",), ("3",)]
    assert mt.prompt_fanout(p).count() == 3
    assert rows(mt.raw_texts(p)) == [("1", "a\nx")]


def test_failed_lookups_stay_as_rows(spark):
    mentions = spark.createDataFrame([(1, "https://github.x/o/r https://github.x/o/none http://y.org/o/r"),
                                      (2, None), (3, "https://github.x/short")], "identifier long, urls string")
    repos = spark.createDataFrame([("o", "r", "r", None, 3, None)],
                                  "owner string, repo string, name string, description string, stars int, language string")
    got = rows(mt.repo_enrich(mentions, repos))
    assert got == [
        (1, 0, "https://github.x/o/r", "r", "Not specified", 3, "Not specified", "ok"),
        (1, 1, "https://github.x/o/none", "Failed request", "Failed request", None, "Failed request", "failed")]


def test_last_url_wins_and_a_miss_names_the_title(spark):
    ids = spark.createDataFrame([(1,), (2,)], "identifier long")
    software = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "identifier long, url string, seq long")
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "identifier long, title string")
    assert rows(mt.lookup_url_lastwins(ids, software, titles)) == [
        (1, "new"), (2, "No url was included with the paper title 'B'")]

from __future__ import annotations

import pytest

from conftest import rows
from corpusmill.plans import calls, lookup, papers, training, web
from corpusmill.sources import readers
from test_minutes import GOOD


def abstracts(tmp_path):
    lines = ["identifier\ttitle\tdescription\tcategory\tlink\tcreator\tdates"]
    for i in range(1, 7):
        code = f"The code number {i} is public. See https://git.x/o/r{i} for it." if i % 2 else f"Nothing on item {i}."
        category = "physics:astro-ph" if i < 6 else "math"
        lines.append(f"{i}\tTitle {i}\t{code};Comment: code\t{category}\tl{i}\tc{i}\t2019")
    (tmp_path / "abstracts.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "urls.tsv").write_text("identifier\turl\n" + "".join(
        f"{i}\thttps://git.x/o/r{i} http://page/{i}\n" for i in range(1, 5)) + "bad\tx\n")
    return str(tmp_path / "abstracts.tsv"), str(tmp_path / "urls.tsv")


def test_papers_to_tables_to_search(spark, tmp_path):
    abstract_path, url_path = abstracts(tmp_path)
    loaded = papers.load_papers(spark, abstract_path, category_only=True)
    assert loaded.count() == 5
    assert papers.load_papers(spark, abstract_path, skip=2, take=2).count() == 2
    urls = papers.load_urls(spark, url_path)
    path = papers.write_cross_checked(loaded, urls, str(tmp_path / "cross"))
    schema = "identifier BIGINT, title STRING, keywords STRING, category STRING, mentioned_software STRING, urls STRING"
    assert readers.csv_dataset(spark, path, schema).count() == 4
    repos = spark.createDataFrame([("o", f"r{i}", f"r{i}", f"tool for item {i}", i, None) for i in (1, 2, 3)],
                                  "owner string, repo string, name string, description string, stars int, language string")
    from corpusmill.operators.mentions import cross_check_mentions
    papers.build_tables(cross_check_mentions(loaded, urls), repos,
                        {"paper_info": str(tmp_path / "pi"), "software": str(tmp_path / "sw")})
    software, info = spark.table("software"), spark.table("paper_info")
    assert software.count() == 4 and info.count() == 4
    failed = software.where("status = 'failed'").collect()
    assert len(failed) == 1 and failed[0]["stars"] is None
    assert sorted(r["id"] for r in info.collect()) == [1, 2, 3, 4]
    found = lookup.search_tables(software, info, "tool item")
    assert found["repositories"].where("score > 0").count() == 3
    assert found["repository_names"].count() == 4
    answers = dict(rows(found["titles_and_keywords"]))
    assert answers[1] == "https://git.x/o/r1"
    several = lookup.search_tables(software, info, ["tool item", "title"])
    assert several["titles_and_repositories"].count() >= 3


def test_page_search(spark):
    lists = spark.createDataFrame([(1, "http://a http://git/b"), (2, "http://c")], "identifier long, urls string")
    pages = spark.createDataFrame([("http://a", "code code code"), ("http://c", "<b>bold title</b>")], "url string, html string")
    found = web.search_pages(lists, pages)
    assert tuple(found["summary"].first()) == (1, 1, 1)
    assert found["counts"].count() == 2 * (13 + 41)
    assert tuple(web.search_pages(lists, pages, most=1)["summary"].first()) == (1, 1, 1)


def test_training_rows_and_splits(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"Title {i}\nOne spectroscopic sentence {i}. Two. Three.") for i in range(50)],
                                "id long, raw_texts string")
    general = spark.createDataFrame([("some other words",)], "text string")
    made = training.training_rows(raw, "light", general)
    assert made.columns == ["id", "raw_texts", "reading_comprehension_texts", "reading_comprehension_texts_q",
                            "reading_comprehension_texts_a"]
    path = training.write_training_splits(made, str(tmp_path / "splits"))
    back = spark.read.parquet(path)
    assert back.count() == 50 and {r["split"] for r in back.select("split").collect()} == {"train", "validation", "test"}


def test_months_are_merged_and_lone_files_stop_the_job(spark, tmp_path):
    for name in ("deep_clean_0701.txt", "deep_clean_9812.txt", "x_metadata_0701.txt"):
        (tmp_path / name).write_text("1\thttp://a\n2\t\n")
    with pytest.raises(ValueError, match="9812"):
        papers.merge_months(spark, str(tmp_path), str(tmp_path / "out"))
    header = "\t".join(readers.ABSTRACT_COLUMNS) + "\n"
    (tmp_path / "x_metadata_0701.txt").unlink()
    (tmp_path / "x_metadata_2007-01.txt").write_text(header + '1\t"a ""quoted""\nline"\ttext\n2\tb\n')
    (tmp_path / "x_metadata_1998-12.txt").write_text(header + "3\tc\n")
    running = papers.merge_months(spark, str(tmp_path), str(tmp_path / "out"))
    assert {r["yymm"]: r["running"] for r in running.collect()} == {"9812": 2, "0701": 4}
    merged = spark.read.csv(str(tmp_path / "out" / "metadata"), sep="\t", header=True, quote='"', escape='"', multiLine=True)
    got = {(r["identifier"], r["title"], str(r["yymm"]).zfill(4)) for r in merged.collect()}
    assert got == {("1", 'a "quoted"\nline', "0701"), ("2", "b", "0701"), ("3", "c", "9812")}


def test_order_of_files_and_places_in_lists(spark, tmp_path):
    """Files count by name, though the scan starts with the longest."""
    (tmp_path / "a.tsv").write_text("identifier\turl\n1\tFIRST\n")
    (tmp_path / "b.tsv").write_text("identifier\turl\n" + "".join(f"{i}\tSECOND\n" for i in range(1, 400)))
    from corpusmill.operators.mentions import first_urls, lookup_url_lastwins
    urls = papers.load_urls(spark, str(tmp_path))
    assert dict(rows(first_urls(urls)))[1] == "FIRST"
    titles = spark.createDataFrame([("1", "t")], "identifier string, title string")
    assert lookup_url_lastwins(urls.select("identifier"), urls, titles).first()["answer"] == "SECOND"
    head = "\t".join(readers.ABSTRACT_COLUMNS) + "\n"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.tsv").write_text(head + "10\tt\n2\tt\n")
    (tmp_path / "p" / "b.tsv").write_text(head + "".join(f"{i}\tt\n" for i in range(100, 300)))
    taken = papers.load_papers(spark, str(tmp_path / "p"), skip=1, take=2).collect()
    assert sorted(r["identifier"] for r in taken) == ["100", "2"]


def test_repositories_of_one_paper_stay_apart_and_last_in_list_wins(spark, tmp_path):
    mentions = spark.createDataFrame([(1, "Paper", ["k"], "http://git/o/z http://git/o/a")],
                                     "identifier long, title string, keywords array<string>, urls string")
    repos = spark.createDataFrame([("o", "z", "z", "gamma ray tool", 1, "C"), ("o", "z", "z", "gamma ray tool", 1, "C"),
                                   ("o", "a", "a", "plain text editor", 2, "C")],
                                  "owner string, repo string, name string, description string, stars int, language string")
    papers.build_tables(mentions, repos, {"paper_info": str(tmp_path / "pi"), "software": str(tmp_path / "sw")})
    found = lookup.search_tables(spark.table("software"), spark.table("paper_info"), "text editor")
    scores = {r["repo_name"]: r["score"] for r in found["repositories"].collect()}
    assert scores["a"] > 0 and scores["z"] == 0
    titled = lookup.search_tables(spark.table("software"), spark.table("paper_info"), "paper")
    assert dict(rows(titled["titles_and_repositories"])) == {1: "http://git/o/a"}


def test_tables_refuse_nulls_and_repeated_keys(spark, tmp_path):
    from corpusmill.sources import writers
    bad = spark.createDataFrame([(1, 1, "t", None), (1, 2, "u", "k")],
                                "id int, paper_identifier long, paper_title string, paper_keywords string")
    with pytest.raises(ValueError, match="repeated id: 1, null paper_keywords: 1"):
        writers.replace_table(bad, "paper_info", str(tmp_path / "x"))


def test_titles_and_keywords(spark):
    mentions = spark.createDataFrame([(1, "gamma rays", "spectra", "u1"), (2, "gamma burst", "gamma", "u2"), (3, "gamma burst", "x", "u3")],
                                     "id long, title string, keywords string, urls string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "id long, embedding array<float>")
    got = rows(lookup.search_titles_and_keywords(mentions, vectors, "gamma", [0.0, 1.0], prefilter=3, k=2))
    assert [(r[0], r[1]) for r in got] == [("gamma burst", "u2"), ("gamma burst", "u3"), ("gamma rays", "u1")]


def test_calls_from_files(spark, tmp_path):
    for day in ("25", "03"):
        (tmp_path / f"operations_call__{day}_04_2024.txt").write_text(GOOD.replace("S7", f"S{day}"))
    (tmp_path / "operations_call__04_04_2024.txt").write_text("nothing")
    rejected = calls.build_calls(spark, str(tmp_path / "*.txt"), str(tmp_path / "table"))
    assert [r["path"].rsplit("/", 1)[1] for r in rejected.collect()] == ["operations_call__04_04_2024.txt"]
    assert rows(spark.table("operations_call").select("shift_name")) == [("S03",), ("S25",)]

"""Plans and skew: what must hold when the tables are large."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from conftest import rows
from corpusmill.functions import sentences as sn
from corpusmill.operators import comprehension as rc
from corpusmill.operators import mentions as mt
from corpusmill.operators import pages as pg
from corpusmill.operators import search as se
from corpusmill.operators.text_index import build_index
from corpusmill.operators import tables as tb
from corpusmill.session import spool

def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words of text. and more").alias("text"),
                             F.lit("unused").alias("other")).write.parquet(path)
    return spark.read.parquet(path)


def test_search_reads_the_index_and_no_texts(spark, tmp_path):
    index = build_index(docs(spark, tmp_path))
    text = plan(se.cosine_search(index, "some words"))
    assert "TakeOrderedAndProject" in text and "WindowGroupLimit" in text
    assert "text:string" not in text and "other" not in text


def mixed(spark, n=640):
    word = F.concat(F.lit("common w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 200, F.lit(" only"), F.col("id"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.concat(word, F.lit(" ")), (1 + F.col("id") % 3).cast("int")).alias("text"))


def test_postings_are_gathered_in_the_tasks_of_their_blocks(spark):
    index = build_index(mixed(spark), docs_per_block=16)
    lying = index.postings.select("block", F.input_file_name().alias("file"))
    files = lying.groupBy("block").agg(F.count_distinct("file").alias("n"), F.min("file").alias("file")).collect()
    assert len(files) == 40 and all(r["n"] == 1 for r in files)
    assert 1 < len({r["file"] for r in files}) <= 10
    assert index.vocabulary.columns == ["term", "df", "idf"] and index.vectors.columns == ["doc_id", "term", "w"]
    assert index.vectors.count() == 640 * 4
    lengths = index.vectors.groupBy("doc_id").agg(F.round(F.sum(F.col("w") * F.col("w")), 9).alias("one"))
    assert [tuple(r) for r in lengths.select("one").distinct().collect()] == [(1.0,)] and lengths.count() == 640


def test_the_index_build_leaves_the_settings_as_they_were(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    build_index(mixed(spark, 40))
    assert spark.conf.get(key) == before


def test_open_blocks_do_not_shuffle_the_entries(spark):
    index = build_index(mixed(spark), docs_per_block=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        text = plan(index.matches(spark.createDataFrame([(0, "common w1"), (1, "w2 v3")], "query_id int, text string"), 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Union" in text and "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_widening_reads_no_words_below_the_least_count(spark):
    text = plan(se.widened_terms(build_index(mixed(spark)), ["common"], least=3))
    assert "GreaterThanOrEqual(df,3)" in text
    found = se.widened_terms(build_index(mixed(spark)), ["common"], per_term=1000, least=4).select("neighbour").collect()
    assert len(found) == 7 + 40


def test_ranking_is_cut_before_the_shuffle(spark, tmp_path):
    scores = se.cosine_scores(docs(spark, tmp_path), ["some", "words"])
    assert "WindowGroupLimit" in plan(se.topk_per_query(scores, 5))


def test_mining_and_minutes_do_not_shuffle(spark, tmp_path):
    texts = docs(spark, tmp_path).select(F.col("doc_id").alias("text_id"), "text")
    for df in (rc.mine(texts), rc.with_examples(texts), rc.reading_comprehension(texts, "d")):
        assert "Exchange" not in plan(df)


def test_sentence_ends_need_no_pattern_over_whole_pieces(spark, tmp_path):
    texts = docs(spark, tmp_path).select(F.col("doc_id").alias("text_id"), "text")
    text = plan(rc.sentences(texts))
    assert sn.LAST_WORD not in text and sn.TRAILS not in text and sn.BLANK_LINE in text


def test_page_counts_do_not_shuffle_html(spark, tmp_path):
    pages = docs(spark, tmp_path).select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("html"))
    assert "Exchange" not in plan(pg.page_counts(pages))


def test_category_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "papers")
    spark.createDataFrame([("1", "a", "d", "math")], "identifier string, title string, description string, category string") \
        .write.parquet(path)
    text = plan(mt.filter_category(spark.read.parquet(path)).select("title"))
    assert "EqualTo(category,physics:astro-ph)" in text and "description" not in text


# -- one key with a third of all rows ---------------------------------------

HOT, ALL = 4000, 12000


def hot_urls(spark):
    identifier = F.when(F.col("id") < HOT, F.lit("7")).otherwise(F.col("id").cast("string"))
    return spark.range(ALL).select(identifier.alias("identifier"), F.concat(F.lit("http://u/"), F.col("id").cast("string")).alias("url"),
                                   F.col("id").alias("seq"))


def test_a_hot_identifier_keeps_its_first_and_last_url(spark):
    first = {r["id_num"]: r["urls"] for r in mt.first_urls(hot_urls(spark)).collect()}
    assert first[7] == "http://u/0" and len(first) == ALL - HOT + 1
    ids = spark.createDataFrame([("7",)], "identifier string")
    titles = spark.createDataFrame([("7", "t")], "identifier string, title string")
    assert rows(mt.lookup_url_lastwins(ids, hot_urls(spark), titles)) == [("7", f"http://u/{HOT - 1}")]


def test_a_hot_repository_keeps_every_row(spark):
    name = F.when(F.col("id") < HOT, F.lit("hot")).otherwise(F.col("id").cast("string"))
    cited = spark.range(ALL).select(F.col("id").alias("identifier"), F.concat(F.lit("https://git.x/o/"), name).alias("urls"))
    repos = spark.createDataFrame([("o", "hot", "hot", "d", 1, "l")],
                                  "owner string, repo string, name string, description string, stars int, language string")
    counts = {r["status"]: r["count"] for r in mt.repo_enrich(cited, repos).groupBy("status").count().collect()}
    assert counts == {"ok": HOT, "failed": ALL - HOT}


def test_a_hot_key_is_split_in_a_shuffled_join(spark):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                            "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "8KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    try:
        papers = spark.range(ALL).repartition(8).select(
            F.when(F.col("id") < HOT, F.lit(7)).otherwise(F.col("id")).alias("id_num"), F.md5(F.col("id").cast("string")).alias("title"))
        joined = papers.join(spool(mt.first_urls(hot_urls(spark))), "id_num")
        assert joined.count() == HOT + (ALL - HOT)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)


def test_copies_of_one_text(spark):
    copies = spark.range(ALL).select(F.col("id").alias("doc_id"), F.when(F.col("id") < HOT, F.lit("same text")).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    distinct = {r["text"]: r["doc_id"] for r in se.distinct_content(copies).collect()}
    assert distinct["same text"] == 0 and len(distinct) == ALL - HOT + 1
    df = {r["term"]: r["df"] for r in se.document_frequency(copies).where("df > 1").collect()}
    assert df == {"same": HOT, "text": ALL}


def test_a_hot_url_is_scanned_once(spark):
    lists = spark.range(ALL).select(F.col("id").alias("identifier"), F.when(F.col("id") < HOT, F.lit("http://hot http://git/h"))
                                    .otherwise(F.concat(F.lit("http://p/"), F.col("id").cast("string"))).alias("urls"))
    pages = spark.createDataFrame([("http://hot", "code code"), (f"http://p/{HOT}", "code")], "url string, html string")
    scan = pg.page_scan(lists, pages)
    assert {r["url"]: r["keyword_total"] for r in scan.collect()} == {"http://hot": 2, f"http://p/{HOT}": 1}
    assert pg.search_summary(lists, scan).first()["git_urls"] == HOT


def test_numbering_a_hot_key(spark):
    hot = hot_urls(spark).select("identifier", "seq")
    got = tb.row_ids(hot, "identifier", "seq")
    assert got.agg(F.countDistinct("id"), F.max("id")).first()[:] == (ALL, ALL)

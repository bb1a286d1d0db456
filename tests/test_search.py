from __future__ import annotations

import math
import re
from collections import Counter

import duckdb

from checks import ORACLES
from conftest import rows
from corpusmill.operators import search as se
from corpusmill.operators import text_index as ti
from corpusmill.operators.text_index import TextIndex, build_index, open_index

DOCS = [(1, "The black hole and the galaxy"), (2, "galaxy galaxy cluster"), (3, ""), (4, "a b c"),
        (5, "Black hole astronomy"), (6, "black hole astronomy"), (7, None)]


def brute(docs, query):
    """TF-IDF cosine in plain Python."""
    tokens = {i: re.findall(r"\b\w\w+\b", (t or "").lower()) for i, t in docs}
    df = Counter(w for ws in tokens.values() for w in set(ws))
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(words):
        raw = {w: n * idf[w] for w, n in Counter(words).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()} if norm else {}

    q = vector(re.findall(r"\b\w\w+\b", query.lower()))
    return {i: round(sum(x * q.get(w, 0) for w, x in vector(ws).items()), 6) for i, ws in tokens.items()}


def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_scores_equal_brute_force_and_keep_zeros(spark):
    for query in ("black hole", "galaxy the", "unknown words only"):
        got = {r["doc_id"]: r["score"] for r in se.cosine_scores(corpus(spark), [query]).collect()}
        assert got == brute(DOCS, query)


def test_zero_scores_fill_up_in_id_order(spark):
    found = [tuple(r) for r in se.cosine_search(corpus(spark), "unknown", 3).collect()]
    assert found == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_ties_go_to_the_smaller_id_and_copies_collapse(spark):
    best = [tuple(r) for r in se.cosine_search(corpus(spark), "astronomy", 2).collect()]
    assert [i for i, _ in best] == [5, 6] and best[0][1] == best[1][1]
    lower = spark.createDataFrame([(i, t.lower() if t else t) for i, t in DOCS], "doc_id long, text string")
    found = se.multi_query_search(lower, ["astronomy", "galaxy"], 3, 10).collect()
    texts = [r["text"] for r in found]
    assert len(texts) == len(set(texts))
    assert next(r["doc_id"] for r in found if r["text"] == "black hole astronomy") == 5


def test_many_queries_equal_single_ones(spark):
    queries = ["black hole", "galaxy cluster", "zzz"]
    together = se.cosine_scores(corpus(spark), queries)
    for i, query in enumerate(queries):
        got = {r["doc_id"]: r["score"] for r in together.where(f"query_id = {i}").collect()}
        assert got == brute(DOCS, query)


def test_a_shuffled_vocabulary_gives_the_same_scores(spark):
    before = rows(se.cosine_scores(corpus(spark), ["black galaxy"]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(se.cosine_scores(corpus(spark), ["black galaxy"])) == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_knn_orders_by_distance(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [5.0, 5.0])],
                                    "vec_id long, embedding array<float>")
    found = rows(se.knn_vectors(vectors, [[1.0, 0.0], [5.0, 4.0]], 2))
    assert found == [(0, 2, 0.0, 1), (0, 3, 0.0, 2), (1, 2, 32.0, 2), (1, 4, 1.0, 1)]


def test_fuse_keeps_common_rows_lowest_first(spark):
    a = spark.createDataFrame([(1, 0.4), (2, 0.1), (3, 0.9)], "doc_id long, score double")
    b = spark.createDataFrame([(1, 0.0), (2, 0.5), (4, 0.1)], "doc_id long, score double")
    assert [tuple(r) for r in se.fuse_avg_score(a, b).collect()] == [(1, 0.2), (2, 0.3)]


def test_ids_as_text_and_number_intersect(spark):
    a = spark.createDataFrame([("1",), ("2",), ("x",)], "doc_id string")
    b = spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert rows(se.intersect_hits(a, b)) == [(2,)]


def test_phrases_of_short_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, ""), (3, "aa aa aa aa")], "doc_id long, text string")
    found = se.keyphrases_topk(docs, top=2).collect()
    assert {r["doc_id"] for r in found} == {1, 3}
    assert max(r["rank"] for r in found) <= 2


def test_phrases_go_on_below_many_that_clash(spark):
    """Sixty phrases hold the best word and are dropped; the words after them still come."""
    texts = [(1, " ".join(f"data item{i:02d}." for i in range(60))), (2, "aa bb"), (3, ""), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = rows(se.keyphrases_topk(docs).select("doc_id", "phrase", "score", "rank"))
    assert [(r[3], r[1]) for r in sorted(found, key=lambda r: r[3]) if r[0] == 1] == [(1, "data")] + [(i + 2, f"item{i:02d}") for i in range(5)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert sorted(connection.execute(ORACLES["keyphrases_topk"]).fetchall(), key=repr) == found


def many(spark, n=600):
    """Two rare words in few documents, a frequent one in all; lengths differ, so weights do."""
    texts = [(i, "common " * (1 + i % 3) + f"filler{i % 50} " * (i % 40) + ("rare " * 3 if i % 97 == 5 else "") + ("odd" if i % 5 == 0 else ""))
             for i in range(n)]
    return texts, spark.createDataFrame(texts, "doc_id long, text string")


def test_index_finds_what_all_scores_give(spark):
    texts, docs = many(spark)
    index = build_index(docs, docs_per_block=16)
    queries = ["rare odd", "common", "common filler7 filler7", "unknown", "odd rare common filler3", "odd"]
    got = [tuple(r) for r in index.search(queries, 7).orderBy("query_id", "rank").collect()]
    wanted = []
    for i, query in enumerate(queries):
        scores = brute(texts, query)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7]
        wanted += [(i, doc, score, rank + 1) for rank, (doc, score) in enumerate(best)]
    assert got == wanted
    again = open_index(spark, index.path)
    assert [tuple(r) for r in again.search(queries, 7).orderBy("query_id", "rank").collect()] == wanted


def test_blocks_that_cannot_reach_the_kth_score_are_not_scored(spark, monkeypatch):
    texts, docs = many(spark)
    index = build_index(docs, docs_per_block=8)
    scored = []
    plain = TextIndex._scored

    def counted(near, weights, blocks):
        scored.append(blocks.count())
        return plain(near, weights, blocks)

    monkeypatch.setattr(TextIndex, "_scored", staticmethod(counted))
    found = index.search(["rare"], 2).collect()
    holding = index.postings.where("term = 'rare'").count()
    assert holding > ti.FIRST_BLOCKS and sum(scored) < holding
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"])] == [
        i for i, s in sorted(brute(texts, "rare").items(), key=lambda x: (-x[1], x[0]))[:2]]


def test_scan_is_filtered_by_the_terms_asked_for(spark, capsys):
    index = build_index(many(spark)[1], docs_per_block=16)
    weights = index.weights(spark.createDataFrame([(0, "rare odd")], "query_id int, text string"))
    index._near(weights).explain("formatted")
    assert "In(term, [odd,rare])" in capsys.readouterr().out.replace("[rare,odd]", "[odd,rare]")


def test_hundreds_of_queries_at_once(spark):
    texts, docs = many(spark)
    index = build_index(docs, docs_per_block=16)
    asked = spark.createDataFrame([(i, t) for i, t in texts[:300]], "query_id long, text string")
    found = {(r["query_id"], r["rank"]): r["score"] for r in index.search(asked, 3).collect()}
    assert len(found) == 900 and all(found[i, 1] == 1.0 for i, _ in texts[:300])
    for i in (5, 120, 299):
        assert [found[i, k] for k in (1, 2, 3)] == sorted(brute(texts, texts[i][1]).values(), reverse=True)[:3]


def test_index_of_no_documents_and_of_equal_ids(spark):
    assert build_index(corpus(spark).limit(0)).search(["x"], 3).collect() == []
    twice = spark.createDataFrame([(1, "one two"), (1, "two three"), (None, "four")], "doc_id long, text string")
    found = [tuple(r) for r in build_index(twice).search(["three"], 2).orderBy("rank").collect()]
    assert found[0][1] == 1 and len(found) == 2


def test_queries_are_widened_by_words_of_the_same_documents(spark):
    texts = [(i, "star bright sky" if i < 6 else "stone grey ground" if i < 12 else "star stone the") for i in range(14)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, text string"))
    found = {(r["term"], r["rank"]): r["neighbour"] for r in se.widened_terms(index, ["star", "nothing"], 2).collect()}
    assert found == {("star", 1): "bright", ("star", 2): "sky"}
    wide = {r["query_id"]: r["text"] for r in se.widened_queries(index, ["star", "nothing"], 2).collect()}
    assert wide == {0: "star bright sky", 1: "nothing"}

"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import glob
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import jaccard
from corpusmill.llm.common import prepare
from corpusmill.llm.grades import Grades, fit, grade
from corpusmill.llm.jaccard import jaccard_join, one_of_each
from corpusmill.llm.licenses import license_scan
from corpusmill.llm.neighbours import nearest
from corpusmill.llm.packing import pack
from corpusmill.llm.quality_rules import quality_rules
from corpusmill.llm.sentencepiece import decode, encode
from corpusmill.llm.sharding import shard_by_bytes, text_size
from corpusmill.llm.substrings import remove_repeats
from corpusmill.llm.toxicity import Chain, LinearModel, toxicity, train
from corpusmill.session import discard, spool

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PLAIN = "the of and to a in is that for it " * 12
ROWS = [(1, PLAIN, "en"), (1, PLAIN, "en"), (2, None, None), (3, "", "xx"), (None, "Lonely null id.", "en"),
        (4, LONG, "en"), (5, " \t\n ", None), (6, "été ☃ ▁ x", "fr")]
SCHEMA = "doc_id long, text string, lang string"
#: Names that the operators use themselves, in results or within.
CLASH = ["row", "rid", "id", "kept", "shard", "slot", "n_words", "ids", "is_toxic", "component_id", "licenses", "_text", "words"]


@pytest.fixture(autouse=True, scope="module")
def _prepared(spark):
    prepare(spark)


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASH:
        df = df.withColumn(name, F.lit(-7))
    return df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).cache()


def chain() -> Chain:
    return Chain(["toxic"], {"lonely": 0}, [LinearModel(-4.0, __import__("numpy").array([9.0]))])


def grades() -> Grades:
    import numpy as np

    return fit([b"good words here", b"bad### words###"], np.array([2, 0]), 3, rounds=20)


def sharded(df):
    return shard_by_bytes(df, 3, F.xxhash64("text"), F.col("doc_id"), text_size(F.col("text")))


ROW_WISE = {
    "quality_rules": quality_rules, "toxicity": lambda df: toxicity(df, chain()), "grade": lambda df: grade(df, grades()),
    "license_scan": license_scan, "encode": encode, "decode": lambda df: decode(encode(df)), "jaccard_join": jaccard_join,
    "remove_repeats": remove_repeats, "sharding": sharded,
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_every_row_stays_and_other_columns_are_carried(docs, name):
    out = ROW_WISE[name](docs)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert all(r["words"] == -7 for r in rows)


@pytest.mark.parametrize("name", ROW_WISE)
def test_empty_table(docs, name):
    assert ROW_WISE[name](docs.where("false")).collect() == []


@pytest.mark.parametrize("name", ROW_WISE)
def test_missing_rows_of_text_only(docs, name):
    """A table of one null text."""
    assert len(ROW_WISE[name](docs.where("text is null")).collect()) == 1


def test_defined_results_of_null_and_empty_texts(docs):
    quality = {(r["doc_id"], r["text"] is None): r for r in quality_rules(docs).collect()}
    assert quality[2, True]["n_words"] == 0 and quality[2, True]["base_failed"] and not quality[2, True]["kept"]
    sizes = {r["doc_id"]: r["size"] for r in docs.select("doc_id", text_size(F.col("text")).alias("size")).collect()}
    assert sizes[2] == 8 and sizes[3] == 8
    ids = {r["doc_id"]: r["ids"] for r in encode(docs).collect()}
    assert ids[2] is None and ids[3] == []
    texts = {r["doc_id"]: (r["text"], r["decoded"]) for r in decode(encode(docs)).collect()}
    assert all(a == b for a, b in texts.values())
    lonely = {r["doc_id"]: r["is_toxic"] for r in toxicity(docs, chain()).collect()}
    assert lonely[None] and not lonely[2]
    assert {r["doc_id"]: r["licenses"] for r in license_scan(docs).collect()}[2] == []


def test_null_and_repeated_ids_in_joins(docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(docs).collect()]
    assert got.count((1, 10, 1)) == 2
    assert (2, 0, 2) in got and (3, 0, 3) in got and (5, 0, 5) in got
    assert (None, 1, None) in got
    firsts = [r["doc_id"] for r in one_of_each(docs).collect()]
    assert firsts.count(1) == 1 and len(firsts) == len(ROWS) - 1
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    assert cut[1] == (120, 0) and cut[2] == (0, 0) and cut[None] == (3, 0)


def test_pack_edges(spark, docs):
    rows = pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert [(r["length"], r["start"], r["ids_crc32"]) for r in rows if r["doc_id"] == 2] == [(1, 0, 558161692)]
    assert pack(docs.where("false")).collect() == []


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("rank", F.lit(2))
    got = [tuple(r) for r in nearest(df, df.where("vec_id in (0, 2, 3, 4, 8)"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0)]
    assert nearest(df.where("false"), df.where("false")).collect() == []


@pytest.mark.parametrize("unit", [2.0**530, 2.0**-540, 2.0**1010])
def test_neighbours_of_huge_and_tiny_vectors(spark, unit):
    """Scaled by a power of two, the same neighbours at distances scaled alike."""
    lots = np.random.default_rng(8)
    points = lots.normal(size=(60, 5))
    found = []
    for factor in (1.0, unit):
        df = spark.createDataFrame([(i, (p * factor).tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
        found.append([tuple(r) for r in nearest(df, df.where("vec_id < 6"), 4).orderBy("query_id", "rank").collect()])
    assert [r[:3] for r in found[0]] == [r[:3] for r in found[1]] and len(found[0]) == 24
    assert [r[3] * unit for r in found[0]] == [r[3] for r in found[1]]


def test_ids_that_are_no_numbers(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([("a", text), ("b", text), ("7", text), (None, "x")], "doc_id string, text string")
    assert jaccard_join(docs).count() == 4 and remove_repeats(docs).count() == 4


def test_models_without_labels():
    import numpy as np

    none = train([], np.zeros((0, 2)), [], ["a", "b"])
    assert max(none.probabilities({"x"})) < 1e-6
    assert fit([], np.zeros(0, dtype=np.int64), 3).above(np.zeros(1))[0].min() > 0.99
    partly = train([np.array([0]), np.array([1])] * 10, np.array([[1, np.nan], [0, np.nan]] * 10), ["x", "y"], ["a", "b"])
    assert len(partly.probabilities({"x"})) == 2


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    sf_dir = "/root/testdata/sf0.001"
    given = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("rid"))
    for table in (given, given.where("false")):
        out = stage(spark, table, sf_dir)
        out.collect()
        if stage is not corpus_pipeline.packed:
            assert out.columns == list(corpus_pipeline.COLUMNS)


def test_postings_of_keys_that_meet_are_kept_across_batches(monkeypatch):
    monkeypatch.setattr(jaccard, "MET_AT_ONCE", 2)
    keys = [1, 2, 2, 2, 2, 3, 4, 4, 5]
    batches = [pa.RecordBatch.from_pydict({"key": keys[i:i + 1], "rid": [i]}) for i in range(len(keys))]
    assert [r for b in jaccard._met(iter(batches)) for r in b.column("rid").to_pylist()] == [1, 2, 3, 4, 6, 7]


def shuffled(spark) -> set[str]:
    return set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/**/shuffle_*.data", recursive=True))


def test_what_was_shuffled_for_a_written_table_is_deleted(spark):
    kept = shuffled(spark)
    written = spool(spark.range(4000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    until = time.time() + 10
    while shuffled(spark) - kept and time.time() < until:  # in the background
        time.sleep(0.2)
    assert not shuffled(spark) - kept
    assert written.count() == 1000


def test_discarded_tables_are_gone(spark):
    written = spool(spark.range(10).repartition(3), "numbers")
    files = [f.removeprefix("file://") for f in written.inputFiles()]
    assert all(os.path.exists(f) for f in files)
    discard(written)
    assert not any(os.path.exists(f) for f in files)


def test_texts_are_read_twice_for_their_shingles(spark, monkeypatch):
    tasks = []
    kind = type(spark.range(1))
    plain = kind.mapInArrow

    def counted(df, fn, schema, *more):
        if {"rid", "text"} == set(df.columns):
            tasks.append(schema)
        return plain(df, fn, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(12)], "doc_id long, text string")
    assert jaccard_join(docs).count() == 12 and len(tasks) == 2

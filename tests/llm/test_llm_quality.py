"""Documents without a known language, and junk of other kinds than the planted one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.common import prepare
from corpusmill.llm.quality_rules import quality_rules
from corpusmill.session import spool

SF = "/root/testdata/sf0.01"
RNG = random.Random(4)
JUNK = {
    "numbers": " ".join(str(RNG.randrange(10**6)) for _ in range(60)),
    "questions": " ".join(f"w{i}????" for i in range(60)),
    "mojibake": " ".join("".join(RNG.choice("\u00c3\u00a9\u00e2\u20ac\u2122\ufffd") for _ in range(6)) for _ in range(60)),
    "script": " ".join("".join(RNG.choice("\u0410\u0431\u0432\u4e2d\u6587\u5b57") for _ in range(6)) for _ in range(60)),
    "encoded": " ".join("".join(RNG.choice("ABCDefgh0123456789+/=") for _ in range(20)) for _ in range(60)),
    "controls": " ".join("".join(RNG.choice("abc\\x01\\x02\\x7f") for _ in range(8)) for _ in range(60)),
    "emoji": " ".join("".join(RNG.choice("\U0001f600\U0001f525\u2603") for _ in range(3)) for _ in range(60)),
}


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.mark.parametrize("lang", ["en", None, "xx"])
def test_other_junk_is_rejected_in_any_language(spark, docs, lang):
    rows = [(-1 - k, text, lang) for k, text in enumerate(JUNK.values())]
    judged = quality_rules(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("doc_id < 0")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in judged.collect()}
    assert {name: got[-1 - k] for k, name in enumerate(JUNK)} == dict.fromkeys(JUNK, (False, False))


def test_a_single_document_without_language_is_held_against_all(spark, docs):
    row = spark.createDataFrame([(-1, JUNK["numbers"], None)], docs.schema)
    alone = quality_rules(docs.unionByName(row)).where("doc_id < 0").first()
    assert alone["char_distance"] > 0.5 and alone["word_distance"] > 0.2


def test_clean_documents_without_language_are_kept(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules(docs.withColumn("lang", F.lit(None).cast("string"))).join(labels, "doc_id").where("not base_failed")
    clean, junk = (judged.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert clean > 0.99 and junk < 0.5


def test_counts_are_written_beside_the_ids_alone(spark, monkeypatch):
    rows = [(i, f"the word {i} of a line and more of it " * 8, "en", "a") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    written = []
    monkeypatch.setattr("corpusmill.llm.quality_rules.spool", lambda df, label: written.append(set(df.columns)) or spool(df, label))
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert not written[0] & {"row", "text"} and "rid" in written[0]
    twice = quality_rules(docs.union(docs)).collect()
    null = quality_rules(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(got) == len(null) == 40 and len(twice) == 80
    assert sorted(r[1:] for r in null) == sorted(r[1:] for r in got.values())
    assert {r["doc_id"]: r["n_words"] for r in twice} == {k: r["n_words"] for k, r in got.items()}

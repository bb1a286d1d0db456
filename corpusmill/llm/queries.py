"""The queries of this package: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.collocations import SQL as COLLOCATION_SQL
from corpusmill.llm.collocations import collocations
from corpusmill.llm.common import prepare
from corpusmill.llm.fim import SQL as FIM_SQL
from corpusmill.llm.fim import fill_in_middle, restored
from corpusmill.llm.grades import fitted_grades, grade
from corpusmill.llm.hmm import lm_scores
from corpusmill.llm.jaccard import jaccard_join
from corpusmill.llm.licenses import SQL as LICENSE_SQL
from corpusmill.llm.licenses import license_scan
from corpusmill.llm.neighbours import nearest
from corpusmill.llm.packing import pack
from corpusmill.llm.quality_rules import COUNTS, quality_rules
from corpusmill.llm.sentencepiece import decode, encode
from corpusmill.llm.sharding import shard_by_bytes, text_size
from corpusmill.llm.substrings import remove_repeats
from corpusmill.llm.toxicity import CATEGORIES, fitted, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return decoded.select("doc_id", F.size("ids").alias("n_ids"), "ids", "score",
                          F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted_grades(docs, table(spark, sf_dir, "labels"))
    graded = grade(docs, model)
    return graded.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"),
                         F.round("tail_probability", 6).alias("tail_probability"), "kept")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sharded = shard_by_bytes(docs, 24, F.xxhash64("text"), F.col("doc_id"), text_size(F.col("text")))
    return sharded.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"),
                          F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fitted(docs, table(spark, sf_dir, "labels"))
    scored = toxicity(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], "is_toxic")


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "sentence_ids", "licenses")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", F.round("char_distance", 9).alias("char_distance"),
                         F.round("word_distance", 9).alias("word_distance"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op12_phrase_collocations"] = COLLOCATION_SQL
ORACLES["op11_fill_in_middle"] = FIM_SQL
ORACLES["op7_license_scan"] = LICENSE_SQL

"""The corpus pipeline: documents through one operator after another, each stage written and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import prepare
from corpusmill.llm.jaccard import one_of_each
from corpusmill.llm.packing import pack
from corpusmill.llm.quality_rules import quality_rules
from corpusmill.llm.queries import QUERIES as OPERATOR_QUERIES
from corpusmill.llm.substrings import remove_repeats
from corpusmill.llm.toxicity import fitted, toxicity
from corpusmill.session import configure, spool

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on the given labels, does not reject."""
    prepare(spark)
    chain = fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs.select(*COLUMNS), chain).where(~F.col("is_toxic")).select(*COLUMNS)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id holds; the others' texts stay as they are."""
    prepare(spark)
    cut = remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    return cut.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    prepare(spark)
    pieces = pack(docs.select("doc_id", "text"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality rules", keep_good), ("toxicity", keep_harmless), ("n-gram Jaccard join", keep_first),
          ("substring dedup", cut_repeats), ("best-fit packing", packed)]

#: The stages draw on regular expressions of two engines, fitted models and a packing program: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written below the shared folder and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {**OPERATOR_QUERIES, "pipeline": run}

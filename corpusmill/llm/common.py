"""What several operators of this package share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import spool

#: Word separators of every operator here: ASCII blanks and nothing else, as `bytes.split()` has them.
BLANK = r"\x20\x09-\x0D"

#: Rows handed to Python at once; texts may be long, so a batch stays small.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python by rows, and send this package's functions along with the tasks.

    What was shuffled for a written table is deleted with its writing, not when the driver collects garbage.
    """
    cloudpickle.register_pickle_by_value(sys.modules["corpusmill.llm"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"[^{BLANK}]+"), F.lit(0)), F.array().cast("array<string>"))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """(row, ...): all input columns as one struct, out of the way of the operator's own names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The input columns again, then the added ones; an input column of an added name gives way to it."""
    kept = [F.col("row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*kept, *added)


def column_or_null(docs: DataFrame, name: str, kind: str) -> Column:
    """The column cast to a type, or nulls where the table lacks it."""
    return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind)


def fields(df: DataFrame, more: str) -> T.StructType:
    """The schema of `df` followed by the columns of a DDL text."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def numbered_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a whole number; null for any other."""
    return F.col(f"`{id_col}`").try_cast("bigint") if id_col in docs.columns else F.lit(None).cast("bigint")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Ids (`id`) that are null or stand in several rows."""
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull())


def identified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(rid, id, text, row) and whether rid is a number of our own: it is the id where ids are unique.

    An id that is no whole number counts as null; such rows are told apart by numbers of our own.
    """
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       numbered_id(docs, id_col).alias("id"),
                       column_or_null(docs, text_col, "string").alias("text"))
    if repeated_ids(wide).isEmpty():
        return wide.withColumn("rid", F.col("id")), False
    return spool(wide.withColumn("rid", F.monotonically_increasing_id()), "numbered"), True

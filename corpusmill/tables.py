"""Small literal tables: parameters that have to be joined or exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    """Parameter rows as a DataFrame the planner knows to be small."""
    structs = [F.struct(*[F.lit(value).alias(name) for name, value in zip(columns, row)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))

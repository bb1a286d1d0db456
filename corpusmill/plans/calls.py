"""Minutes files to the table `operations_call`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import minutes as mn
from corpusmill.sources import readers, writers


def build_calls(spark: SparkSession, path: str, table_path: str | None = None) -> DataFrame:
    """Replace the table from all files of a glob; return the paths of incomplete files."""
    files = readers.whole_text(spark, path)
    writers.replace_table(mn.sort_by_date(mn.operations_call(files)), "operations_call", table_path)
    return mn.rejected_calls(files)

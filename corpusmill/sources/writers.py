"""Writers; each returns the path or table it wrote."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The relational tables, their columns and the columns that may not be null.
TABLES = {
    "paper_info": "id INT, paper_identifier BIGINT, paper_title STRING, paper_keywords STRING",
    "software": "id INT, url STRING, repo_name STRING, repo_description STRING, stars INT, language STRING, "
                "paper_identifier BIGINT, status STRING",
    "operations_call": "shift_name STRING, ops_call_date DATE, attendees STRING, ops_pages STRING, ops_intro STRING, "
                       "day_shift_report STRING, hessiu_status STRING, fc_status STRING, daq_status STRING, "
                       "tracking STRING, pointing STRING, aob STRING",
}
NOT_NULL = {
    "paper_info": ("paper_identifier", "paper_title", "paper_keywords"),
    # A failed look-up has no number of stars.
    "software": ("url", "repo_name", "repo_description", "language", "paper_identifier"),
    "operations_call": ("shift_name", "ops_call_date"),
}
KEYS = {"paper_info": "id", "software": "id", "operations_call": "shift_name"}
#: The column by which the rows of a table are dealt to its files: tables looked up by one column are joined without a shuffle.
BUCKETED = {"paper_info": "paper_identifier", "software": "paper_identifier", "operations_call": "shift_name"}
BUCKETS = 16


_KEEP = {"quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False,
         "ignoreTrailingWhiteSpace": False}


def _gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a folder brought together before the write, so that not every task adds a file to every folder.

    The rebalance hint leaves it to AQE to split a folder that holds much of the rows.
    """
    return rows.hint("rebalance", *columns)


def option_name(base: str, category_only: bool, subject_only: bool, skip: int, rows: int) -> str:
    """Data set name that carries the options it was made with."""
    return f"{base}_astroph{int(category_only)}_hess{int(subject_only)}_skiprows{skip}_maxrows{rows}"


def write_jsonl(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").json(path)
    return path


def write_csv(rows: DataFrame, path: str) -> str:
    """Comma CSV with a header; array columns become JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True, **_KEEP)
    return path


def write_tsv_merged(rows: DataFrame, path: str) -> str:
    """Tab-separated files, one folder per month."""
    _gathered(rows, "yymm").write.mode("overwrite").partitionBy("yymm").csv(path, sep="\t", header=True, **_KEEP)
    return path


def _refuse(typed: DataFrame, name: str) -> None:
    """One aggregate over the keys counts all that the table's constraints forbid."""
    key = KEYS[name]
    nulls = [F.sum(F.col(c).isNull().cast("bigint")).alias(f"null {c}") for c in NOT_NULL[name]]
    per_key = typed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *nulls)
    found = per_key.agg(F.coalesce(F.sum((F.col("_n") > 1).cast("bigint")), F.lit(0)).alias(f"repeated {key}"),
                        *[F.coalesce(F.sum(f"`null {c}`"), F.lit(0)).alias(f"null {c}") for c in NOT_NULL[name]]).first()
    wrong = [f"{what}: {n}" for what, n in found.asDict().items() if n]
    if wrong:
        raise ValueError(f"{name} refuses rows with {', '.join(wrong)}")


def _versions(spark: SparkSession, name: str) -> list[str]:
    """The stored versions of a table, oldest first."""
    return sorted(t.name for t in spark.catalog.listTables(pattern=f"{name}__v*") if t.tableType != "VIEW")


def replace_table(rows: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS) -> str:
    """Rebuild one of the known tables; the columns are cast to its types.

    The rows are written beside the stored ones as a new version, sorted and bucketed by the column that look-ups
    use. Only when what was written keeps the table's constraints (no nulls where it has none, no key twice) is the
    name, a view, pointed at it, in one step of the catalog. So the rows are computed once, and a write that fails
    or is refused leaves the old rows in place. The version before stays for those who still read it; older ones go.
    """
    if name not in TABLES:
        raise NameError(f"table name must be one of {', '.join(TABLES)}")
    spark = rows.sparkSession
    fields = T.StructType.fromDDL(TABLES[name]).fields
    typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in fields])
    before = _versions(spark, name)
    version = f"{name}__v{time.time_ns():020d}"
    writer = typed.repartition(buckets, BUCKETED[name]).write.format("parquet").bucketBy(buckets, BUCKETED[name]).sortBy(BUCKETED[name])
    try:
        (writer.option("path", f"{path}/{version}") if path else writer).saveAsTable(version)
        _refuse(spark.table(version), name)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    if any(t.name == name and t.tableType != "VIEW" for t in spark.catalog.listTables(pattern=name)):
        spark.sql(f"DROP TABLE {name}")  # stored under its own name by an earlier release
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for old in before[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    return name


def append_columns(rows: DataFrame, added: DataFrame, on: str, path: str) -> str:
    """The input with further columns, joined on its key."""
    rows.join(added, on).write.mode("overwrite").parquet(path)
    return path


def write_splits(rows: DataFrame, path: str, columns: Sequence[str] = ("split",)) -> str:
    """One folder per split (or shard)."""
    _gathered(rows, *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)
    return path

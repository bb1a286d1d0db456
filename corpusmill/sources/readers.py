"""Readers for the input layouts; every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.records import parsed, records

ABSTRACT_COLUMNS = ("identifier", "title", "description", "category", "link", "creator", "dates")
JSONL_SCHEMA = "prompt STRING, response STRING, source STRING"



def parquet_table(spark: SparkSession, path: str, deal: bool = False) -> DataFrame:
    """A parquet table, scanned as it is split.

    With `deal` a table smaller than one split, which a single task would read, is dealt out to all cores for work that is
    heavy by the row; a larger one stays as it is, whatever its size, so no more than a split is ever moved.
    """
    rows = spark.read.parquet(path)
    if not deal:
        return rows
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size < split else rows


def _delimited(spark: SparkSession, path: str, columns, sep: str, header: bool, line_breaks: bool = False) -> DataFrame:
    """Lines with too many fields dropped, short ones padded with null; empty cells are null.

    Quotes within a quoted cell are doubled and a backslash is a letter like
    any other. With `line_breaks` a quoted cell may hold line breaks; its
    records are then put together from splits of the file (`records`), and the
    result has the columns `file`, `block` and `row` of their places.

    The parser hands over every line whose field count is off; of these the
    ones with too many separators outside quotes go. It must see all columns
    for that, so column pruning inside the parser is off.
    """
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, "_odd"])
    if line_breaks:
        rows = parsed(records(spark, path, sep).withColumn("header", F.col("header") & F.lit(header)), schema, sep, "_odd")
    else:
        rows = (spark.read.schema(schema).option("columnNameOfCorruptRecord", "_odd").option("columnPruning", False)
                .csv(path, sep=sep, header=header, enforceSchema=True, quote='"', escape='"', multiLine=False))
    separators = F.regexp_count(F.regexp_replace("_odd", '"[^"]*"', ""), F.lit(sep))
    too_long = F.coalesce(separators >= len(columns), F.lit(False))
    # Spark reads the odd lines only beside a data column, hence the condition that is always met.
    return rows.where(~too_long & (F.coalesce(F.length(columns[0]), F.lit(0)) >= 0))


def file_order() -> Column:
    """Sorts rows as they stand in their files, files by name; only for use right on a scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def abstracts_tsv(spark: SparkSession, path: str, columns=ABSTRACT_COLUMNS, line_breaks: bool = True,
                  order: str | None = None) -> DataFrame:
    """Paper metadata with a header line; empty cells are null. `order` names a column for the place in the files."""
    rows = _delimited(spark, path, columns, "\t", True, line_breaks)
    place = F.struct("file", "block", "row") if line_breaks else file_order()
    return rows.select(*columns, *([place.alias(order)] if order else []))


def url_list(spark: SparkSession, path: str, header: bool = False, order: str | None = None) -> DataFrame:
    """(identifier, url); an empty URL cell stays an empty text. `order` names a column for the place in the files."""
    rows = _delimited(spark, path, ("identifier", "url"), "\t", header)
    return rows.select("identifier", F.coalesce("url", F.lit("")).alias("url"),
                       *([file_order().alias(order)] if order else []))


def csv_dataset(spark: SparkSession, path: str, schema: str, line_breaks: bool = True, file: str | None = None) -> DataFrame:
    """Comma CSV with a header; with `line_breaks` quoted cells may hold some. `file` names a column for the row's file."""
    if line_breaks:
        rows, source = parsed(records(spark, path, ","), schema, ","), F.col("file")
    else:
        rows = spark.read.schema(schema).csv(path, header=True, multiLine=False, quote='"', escape='"', enforceSchema=True)
        source = F.col("_metadata.file_path")
    named = [source.alias(file)] if file else []
    return rows.select(*[c for c in rows.columns if c not in ("file", "block", "row") or not line_breaks], *named)


def page_inputs(spark: SparkSession, path: str, layout: str = "dataframe") -> DataFrame:
    """(identifier, urls) from either layout: a mentions CSV, with or without an index column, or a merged TSV with one."""
    if layout == "dataframe":
        # By the names in the header, wherever the columns stand; only the first lines are read for them.
        names = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False).columns
        rows = csv_dataset(spark, path, ", ".join(f"`{n}` STRING" for n in names))
        return rows.select(F.col("identifier").cast("string"), F.col("urls").cast("string"))
    if layout == "base_file":
        rows = _delimited(spark, path, ("index", "identifier", "url"), "\t", True)
        return rows.select("identifier", F.col("url").alias("urls"))
    raise ValueError("layout can either be 'dataframe' or 'base_file'")


def month_pattern(folder: str, kind: str, year: str | None = None) -> str:
    """Glob of the month files of one kind; with a two-digit year only that year's files."""
    return f"{folder}/*{kind}_{year or ''}*"


def months(spark: SparkSession, folder: str, kind: str = "clean", year: str | None = None) -> DataFrame:
    """URL lists of all months, or of one two-digit year, with the month as `yymm`.

    The year is part of the glob, so files of other years are never opened.
    """
    rows = _delimited(spark, month_pattern(folder, kind, year), ("identifier", "url"), "\t", False)
    return rows.select("identifier", F.coalesce("url", F.lit("")).alias("url"),
                       F.regexp_extract("_metadata.file_path", kind + r"_(\d{4})", 1).alias("yymm"))


def _month(kind: str) -> Column:
    """`yymm` from a file name with `yymm` or `yyyy-mm` after the kind."""
    short = F.regexp_extract("path", kind + r"_(\d{4})(?!\d|-\d)", 1)
    year, month = (F.regexp_extract("path", kind + r"_\d\d(\d\d)-(\d\d)", i) for i in (1, 2))
    return F.when(short != "", short).otherwise(F.concat(year, month))


def month_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(yymm, path): the file listing of one kind; file contents are not read."""
    listing = spark.read.format("binaryFile").load(month_pattern(folder, kind)).select("path")
    return listing.withColumn("yymm", _month(kind)).where("yymm != ''")


def month_metadata(spark: SparkSession, folder: str, kind: str = "metadata", year: str | None = None) -> DataFrame:
    """Metadata tables of all months, or of one two-digit year, with the month as `yymm`."""
    rows = _delimited(spark, f"{folder}/*{kind}_*", ABSTRACT_COLUMNS, "\t", True, True)
    dated = rows.select(*ABSTRACT_COLUMNS, F.col("file").alias("path")).withColumn("yymm", _month(kind)).drop("path")
    return dated if year is None else dated.where(F.col("yymm").startswith(year))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def table_scan(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def jsonl(spark: SparkSession, path: str, schema: str = JSONL_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def pages_for_urls(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html) for each URL that has a page; the others are skipped."""
    return urls.join(pages.select("url", "html"), "url").where(F.col("html").isNotNull())

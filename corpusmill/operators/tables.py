"""Table checks, numbering, months and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.session import spool


def check_not_null(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many nulls each column has."""
    return table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def check_unique_key(table: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def table_preview_widths(table: DataFrame, max_chars: int = 16) -> DataFrame:
    """One row: the printed width of each column, header included."""
    def width(c: str):
        longest = F.max(F.length(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("None")), 1, max_chars)))
        return F.greatest(longest, F.lit(len(c[:max_chars]))).alias(c)

    return table.agg(*[width(c) for c in table.columns])


def _ranges(keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key columns with `_place`, their number in key order from 1.

    Keys are sorted into ranges, numbered inside their range as they are
    written, and shifted by the size of the ranges before. Only the range
    sizes, one row per partition, pass through a single task.
    """
    counter = F.monotonically_increasing_id()  # partition number above bit 33, row number below
    ranged = spool(keys.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", counter), "ranges")
    numbered = ranged.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = F.broadcast(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_shift")))  # a row per partition
    return numbered.join(shifts, "_range").withColumn("_place", F.col("_place") + F.col("_shift") + 1).drop("_at", "_range", "_shift")


def row_ids(rows: DataFrame, *key: str, name: str = "id") -> DataFrame:
    """Consecutive ids from 1 in key order.

    Rows of one key are told apart by a hash of the whole row and its place in
    the input, so that they fill several ranges if there are many.
    """
    spread = rows.withColumns({"_hash": F.xxhash64(*rows.columns), "_input": F.monotonically_increasing_id()})
    return _ranges(spread, [*key, "_hash", "_input"]).select(F.col("_place").cast("bigint").alias(name), *rows.columns)


def skip_take(rows: DataFrame, key: str | Sequence[str], skip: int = 0, take: int | None = None) -> DataFrame:
    """Rows after the first `skip` in key order, at most `take`; the key must be unique.

    Only the keys are numbered; the rows are then filtered by the two border keys.
    """
    key = [key] if isinstance(key, str) else list(key)
    if take is not None and take <= 0:
        return rows.where(F.lit(False))
    places = _ranges(rows.select(*key), key)
    last = None if take is None else skip + take
    borders = {r["_place"]: tuple(r[k] for k in key) for r in places.where(
        F.col("_place").isin([skip + 1, *([last] if last else [])])).select("_place", *key).collect()}
    if skip + 1 not in borders:
        return rows.where(F.lit(False))

    def border(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(key, values)])

    here = F.struct(*key)
    kept = rows.where(here >= border(borders[skip + 1]))
    return kept.where(here <= border(borders[last])) if last in borders else kept


def limit_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first `n` rows in key order; each task passes on no more than `n`."""
    return rows.orderBy(key).limit(n)


def shuffled_sample(rows: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """`n` rows in an order fixed by a hash of the key."""
    order = F.md5(F.concat(F.lit(salt + "|"), F.col(key).cast("string")))
    return rows.orderBy(order, key).limit(n)


def column_subset_mode(rows: DataFrame, only_reading_comprehension: bool = True, marker: str = "[NEWLINE]") -> DataFrame:
    """Training columns: the text with marked line breaks, or question and answer."""
    if only_reading_comprehension:
        name = "reading_comprehension_texts"
        return rows.select("id", tx.newline_marker(F.col(name), marker).alias(name))
    return rows.select("id", "reading_comprehension_texts_q", "reading_comprehension_texts_a")


def distinct_years(months: DataFrame) -> DataFrame:
    """(yy, year): two-digit years of the months and the full years."""
    return months.select(F.substring("yymm", 1, 2).alias("yy")).distinct().select(
        "yy", tx.century(F.col("yy")).alias("year")).orderBy("year")


def running_rows(months: DataFrame) -> DataFrame:
    """(yymm, rows, running): rows of each month and up to it; one row per month is ordered."""
    counts = months.groupBy("yymm").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(tx.century(F.substring("yymm", 1, 2)), "yymm").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("running", F.sum("rows").over(order))


def union_months(months: Sequence[DataFrame]) -> DataFrame:
    """All rows of all months; a column a month lacks is null."""
    out = months[0]
    for more in months[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def pair_month_files(urls: DataFrame, metadata: DataFrame) -> DataFrame:
    """(yymm, url_path, metadata_path, paired): the first file of each kind per month."""
    def first(files: DataFrame, name: str) -> DataFrame:
        return files.groupBy("yymm").agg(F.min("path").alias(name))

    both = first(urls, "url_path").join(first(metadata, "metadata_path"), "yymm", "full_outer")
    return both.withColumn("paired", F.col("url_path").isNotNull() & F.col("metadata_path").isNotNull())

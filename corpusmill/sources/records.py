"""Records of delimited files whose quoted cells may hold line breaks, read by many tasks.

Such a file cannot be cut at any line, since a line may lie inside a quoted cell. But a line is one of four
functions on the question whether a quoted cell is open: it leaves it as it is, it turns it round, it closes or it
opens one. Within a split the functions before a line are composed by windows, each split comes out as one function,
and these, a row for each split, are composed over the file. So every split is read in a task of its own, and only
lines of records that have several are brought together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import spool


@dataclass(frozen=True)
class _Patterns:
    """Whether a line leaves a quoted cell open: if none was open before it, and if one was."""
    from_outside: str
    from_inside: str

    @classmethod
    def of(cls, sep: str) -> _Patterns:
        s = re.escape(sep)
        quoted = '(?:[^"]|"")*+'
        plain = f"[^{s}]*+"
        cells = f'(?:(?:"{quoted}"{plain}|(?!"){plain}){s})*+'
        opened = f'"{quoted}$'
        return cls(f"^{cells}{opened}", f'^{quoted}$|^{quoted}"{plain}{s}{cells}{opened}')


def _composed(rows: DataFrame, parts: list[str], order: str) -> DataFrame:
    """Adds `before_u` and `before_q`: whether a cell is open before each row, if none and if one was open at the
    start of its part. `u` and `q` say what the row itself makes of either."""
    upto = Window.partitionBy(*parts).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("u") & ~F.col("q")
    counted = rows.withColumn("_turned", F.sum(turns.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("u") == F.col("q"), F.struct(F.col("u").alias("v"), F.col("_turned").alias("at")))
    seen = counted.withColumns({"_fixed": F.last(fixed, ignorenulls=True).over(before),
                                "_before": F.coalesce(F.lag("_turned").over(upto), F.lit(0))})

    def state(start: bool) -> Column:
        turned = (F.col("_before") - F.coalesce("_fixed.at", F.lit(0))) % 2 == 1
        return F.coalesce("_fixed.v", F.lit(start)) != turned

    return seen.withColumns({"before_u": state(False), "before_q": state(True)}).drop("_turned", "_fixed", "_before")


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, row, header, record): the records of all files with their places; `header` marks a file's first."""
    patterns = _Patterns.of(sep)
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    quotes = F.contains("line", F.lit('"'))
    states = lines.withColumns({"u": quotes & F.regexp_like("line", F.lit(patterns.from_outside)),
                                "q": ~quotes | F.regexp_like("line", F.lit(patterns.from_inside))})
    states = _composed(states, ["file", "block"], "row")

    # A row for each split: what it makes of an open cell, and where its last record begins in either case.
    def after(start: str) -> Column:
        return F.max_by(F.when(F.col(start), F.col("q")).otherwise(F.col("u")), "row")

    splits = states.groupBy("file", "block").agg(
        after("before_u").alias("u"), after("before_q").alias("q"), F.min("row").alias("first"),
        F.max(F.when(~F.col("before_u"), F.col("row"))).alias("last_u"), F.max(F.when(~F.col("before_q"), F.col("row"))).alias("last_q"))
    begun = F.when(F.col("before_u"), F.col("last_q")).otherwise(F.col("last_u"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = _composed(splits, ["file"], "block").select("file", "block", "first", F.col("before_u").alias("open"),
        F.last(F.when(begun.isNotNull(), F.struct("block", begun.alias("row"))), ignorenulls=True).over(earlier).alias("carried"))
    placed = states.join(spool(splits, "splits"), ["file", "block"])

    inside = F.when(F.col("open"), F.col("before_q")).otherwise(F.col("before_u"))
    within = Window.partitionBy("file", "block").orderBy("row")
    own = F.last(F.when(~F.col("inside"), F.struct("block", "row")), ignorenulls=True).over(within)
    placed = placed.withColumn("inside", inside).withColumns({
        "start": F.coalesce(own, F.col("carried")), "alone": ~F.col("inside") & ~F.coalesce(F.lead("inside").over(within), F.lit(True)),
        "header": (F.col("block") == 0) & (F.col("row") == F.col("first"))})
    single = placed.where("alone").select("file", "block", "row", "header", F.col("line").alias("record"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "row", "line")))
    several = placed.where("not alone").groupBy("file", "start").agg(F.max("header").alias("header"), ordered.alias("lines")).select(
        "file", "start.block", "start.row", "header", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    return single.unionByName(several).where("record <> ''")


def parsed(rows: DataFrame, schema: str, sep: str, odd: str | None = None) -> DataFrame:
    """The records' cells by the built-in parser, beside `file`, `block`, `row`; `odd` names a column for ill-formed records."""
    options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", **({"columnNameOfCorruptRecord": odd} if odd else {})}
    cells = rows.where("not header").select("file", "block", "row", F.from_csv("record", schema, options).alias("cells"))
    return cells.select("file", "block", "row", "cells.*")

"""Jobs from paper metadata files to written data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import mentions as mt
from corpusmill.operators import tables as tb
from corpusmill.sources import readers, writers


def load_papers(spark: SparkSession, path: str, category_only: bool = False, subject_only: bool = False,
                skip: int = 0, take: int | None = None) -> DataFrame:
    """Paper metadata with the category and subject masks; the subject mask needs the category mask."""
    papers = readers.abstracts_tsv(spark, path)
    if skip or take is not None:
        place = ("_file", "_block", "_row")
        numbered = readers.abstracts_tsv(spark, path, order="_order").select(
            "*", *[F.col("_order").getField(c[1:]).alias(c) for c in place])
        papers = tb.skip_take(numbered, place, skip, take).drop("_order", *place)
    if category_only and subject_only:
        return mt.filter_regex(papers)
    return mt.filter_category(papers) if category_only else papers


def load_urls(spark: SparkSession, path: str) -> DataFrame:
    """URL lists with numeric identifiers; rows keep the order of their files in `seq`."""
    return mt.filter_digit_id(readers.url_list(spark, path, header=True, order="seq"))


def write_prompts(papers: DataFrame, path: str) -> str:
    return writers.write_jsonl(mt.prompt_fanout(papers), path)


def write_raw_texts(papers: DataFrame, path: str) -> str:
    return writers.write_csv(mt.raw_texts(papers), path)


def write_code_mentions(papers: DataFrame, path: str) -> str:
    return writers.write_csv(mt.code_mentions(papers), path)


def write_cross_checked(papers: DataFrame, urls: DataFrame, path: str) -> str:
    return writers.write_csv(mt.cross_check_mentions(papers, urls), path)


def merge_months(spark: SparkSession, folder: str, out: str, year: str | None = None) -> DataFrame:
    """Write the URL lists and metadata of all months (or one year), one folder per month; return the running row counts.

    A month with only one of its two files stops the job before anything is written.
    """
    pairs = tb.pair_month_files(readers.month_files(spark, folder, "clean"),
                                readers.month_files(spark, folder, "metadata"))
    wanted = pairs if year is None else pairs.where(F.col("yymm").startswith(year))
    alone = wanted.where(~F.col("paired")).select("yymm").orderBy("yymm").limit(5).collect()
    if alone:
        raise ValueError(f"months without a partner file: {', '.join(r['yymm'] for r in alone)}")
    rows = readers.months(spark, folder, "clean", year)
    writers.write_tsv_merged(rows, f"{out}/urls")
    writers.write_tsv_merged(readers.month_metadata(spark, folder, "metadata", year), f"{out}/metadata")
    merged = spark.read.schema("identifier STRING, url STRING, yymm STRING").csv(f"{out}/urls", sep="\t", header=True)
    return tb.running_rows(merged)


def build_tables(cross_checked: DataFrame, repos: DataFrame, paths: dict[str, str] | None = None) -> None:
    """Replace the tables `paper_info` and `software`.

    `cross_checked` has its URLs as one space-joined text. The ids of `software`
    follow the papers and then the place of a URL in its list. A failed look-up
    keeps its row, with its `status` and without `stars`.
    """
    paths = paths or {}
    info = mt.paper_info_build(cross_checked)
    writers.replace_table(tb.row_ids(info, "paper_identifier", "paper_title"), "paper_info", paths.get("paper_info"))
    software = mt.repo_enrich(cross_checked, repos)
    writers.replace_table(tb.row_ids(software, "paper_identifier", "pos", "url"), "software", paths.get("software"))

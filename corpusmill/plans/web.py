"""The page job: URL lists in, keyword counts, page titles and a summary out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from corpusmill.operators import pages as pg
from corpusmill.operators import tables as tb
from corpusmill.session import spool


def search_pages(url_lists: DataFrame, pages: DataFrame, keywords: Sequence[str] = pg.KEYWORDS,
                 terms: Sequence[str] = pg.LANGUAGES, most: int | None = None, shuffle: bool = False) -> dict[str, DataFrame]:
    """Scan the listed pages once; every report reads the written scan.

    `most` takes the first lists only, in the order of their identifiers or,
    with `shuffle`, of a hash.
    """
    if most is not None:
        take = tb.shuffled_sample if shuffle else tb.limit_rows
        url_lists = take(url_lists, "identifier", most)
    scan = spool(pg.page_scan(url_lists, pages, keywords, terms), "scan")
    return {"counts": pg.scan_counts(scan), "per_keyword": pg.count_per_keyword(scan, keywords),
            "positive": pg.positive_urls(scan), "true_positive": pg.true_positive_urls(scan),
            "summary": pg.search_summary(url_lists, scan), "titles": pg.page_titles(pages)}

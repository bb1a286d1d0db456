"""Page titles and the scan of web pages for software keywords.

A page is read once and reduced, inside its row, to the counts of the terms
asked for; only these small rows are joined with the URL list.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import html as hx
from corpusmill.functions import text as tx
from corpusmill.tables import literal_table

# Default keywords, and the languages whose names are counted beside them.
KEYWORDS = ("code", "codes", "algorithm", "algorithms", "software", "programming", "script", "pipeline",
            "repository", "notebook", "jupyter", "macro", "development")
LANGUAGES = ("python", "javascript", "java", "c", "c++", "c#", "ruby", "php", "swift", "objective-c", "go", "rust",
             "kotlin", "typescript", "perl", "shell", "r", "matlab", "html", "css", "sql", "markdown", "dart", "scala",
             "haskell", "lua", "groovy", "erlang", "elixir", "julia", "coffeescript", "f#", "visual basic",
             "assembly", "racket", "scheme", "prolog", "ada", "fortran", "cobol", "zip")


def page_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add title, meta_description, og_title, first_h1, first_b and page_title."""
    cut = pages.withColumn("_tokens", hx.tokens(F.col(html)))
    m = F.col("_tokens")
    parts = cut.withColumns({
        "title": hx.title_tag(m), "meta_description": hx.meta_description(m), "og_title": hx.og_title(m),
        "first_h1": hx.first_h1(m), "first_b": hx.first_b(m)}).drop("_tokens")
    order = ("title", "meta_description", "og_title", "first_h1", "first_b")
    return parts.withColumn("page_title", hx.best_title(*[F.col(c) for c in order]))


def _count_array(text: Column, words: Column, terms: Sequence[str]) -> Column:
    """array<struct<term, pos, cnt>> in the order of `terms`, zeros kept."""
    plain = [t for t in terms if re.fullmatch(r"\w+", t)]

    def counts(hits: Column) -> Column:
        def count(term: str) -> Column:
            if term in plain:
                return F.size(F.filter(hits, lambda h: h == term))
            return F.regexp_count(text, F.lit(r"(?U)\b" + re.escape(term) + r"\b"))
        return F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("pos"), count(t).cast("bigint").alias("cnt"))
                         for i, t in enumerate(terms)])

    return tx.bind(F.filter(words, lambda w: w.isin(*plain)), counts)


def _token_counts(words: Column, terms: Sequence[str], wanted: Column) -> Column:
    """array<struct<term, cnt>> of whole tokens, all zero unless `wanted`."""
    def counts(hits: Column) -> Column:
        return F.array(*[F.struct(F.lit(t).alias("term"),
                                  F.when(wanted, F.size(F.filter(hits, lambda h: h == F.lit(t)))).otherwise(0)
                                  .cast("bigint").alias("cnt")) for t in terms])

    return tx.bind(F.filter(words, lambda w: w.isin(*terms)), counts)


def page_counts(pages: DataFrame, keywords: Sequence[str] = KEYWORDS, terms: Sequence[str] = LANGUAGES) -> DataFrame:
    """(url, keywords, top_keyword, extensions): the counts of each page, as arrays."""
    text = pages.where("html is not null").select("url", F.lower(hx.page_text(F.col("html"))).alias("text"))
    words = text.withColumn("words", tx.words(F.col("text")))
    counted = words.select("url", "words", _count_array(F.col("text"), F.col("words"), keywords).alias("keywords"))
    best = F.array_max(F.transform("keywords", lambda k: F.struct(
        k["cnt"].alias("cnt"), (-k["pos"]).alias("order"), k["term"].alias("term"))))
    topped = counted.withColumn("top_keyword", best["term"])
    wanted = F.array_contains("words", F.col("top_keyword"))
    return topped.select("url", "keywords", "top_keyword",
                         _token_counts(F.col("words"), terms, wanted).alias("extensions"))


def keyword_counts(pages: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """(url, term, pos, cnt): every keyword of every page, zeros kept."""
    return page_counts(pages, keywords, ("-",)).select("url", F.inline("keywords"))


def top_keyword(counts: DataFrame) -> DataFrame:
    """(url, term): the most frequent keyword, the earlier one on ties."""
    return counts.groupBy("url").agg(F.max_by("term", F.struct("cnt", -F.col("pos"))).alias("term"))


def extension_counts(pages: DataFrame, keywords: Sequence[str] = KEYWORDS,
                     terms: Sequence[str] = LANGUAGES) -> DataFrame:
    """(url, term, cnt): counts of the terms on pages that hold their own top keyword."""
    return page_counts(pages, keywords, terms).select("url", F.inline("extensions"))


def listed_urls(url_lists: DataFrame, urls: str = "urls") -> DataFrame:
    """(url): every URL of every list, repetitions kept."""
    return url_lists.select(F.explode(tx.url_list(F.col(urls))).alias("url"))


def page_scan(url_lists: DataFrame, pages: DataFrame, keywords: Sequence[str] = KEYWORDS,
              terms: Sequence[str] = LANGUAGES) -> DataFrame:
    """(url, keywords, extensions, keyword_total, extension_total) of each listed page once.

    URLs with "git" in them are left to `search_summary`, which counts them.
    Of several pages under one URL the one with the most hits stands for it.
    """
    wanted = listed_urls(url_lists).where(~F.col("url").contains("git")).distinct()
    total = lambda name: F.aggregate(name, F.lit(0).cast("bigint"), lambda acc, x: acc + x["cnt"])
    counted = page_counts(pages.where(~F.col("url").contains("git")), keywords, terms).select(
        "url", "keywords", "extensions", total("keywords").alias("keyword_total"),
        total("extensions").alias("extension_total"))
    row = F.struct("keyword_total", "extension_total", "keywords", "extensions")
    single = counted.groupBy("url").agg(F.max(row).alias("row"))
    return single.join(wanted, "url", "left_semi").select(
        "url", "row.keywords", "row.extensions", "row.keyword_total", "row.extension_total")


def scan_counts(scan: DataFrame) -> DataFrame:
    """(url, kind, term, cnt): the scan in long form."""
    def marked(column: str, kind: str) -> Column:
        return F.transform(column, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["term"].alias("term"), x["cnt"].alias("cnt")))

    return scan.select("url", F.inline(F.concat(marked("keywords", "keyword"), marked("extensions", "extension"))))


def count_per_url(scan: DataFrame) -> DataFrame:
    return scan.select("url", F.col("keyword_total").alias("cnt"))


def ext_count_per_url(scan: DataFrame) -> DataFrame:
    return scan.select("url", F.col("extension_total").alias("cnt"))


def count_per_keyword(scan: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """(term, cnt) over all pages; keywords found nowhere stay with zero."""
    zeros = literal_table(scan.sparkSession, [(k, 0) for k in keywords], ["term", "cnt"])
    found = scan.select(F.inline("keywords")).select("term", "cnt")
    return found.unionByName(zeros).groupBy("term").agg(F.sum("cnt").alias("cnt"))


def positive_urls(scan: DataFrame) -> DataFrame:
    """URLs with at least one keyword hit."""
    return scan.where(F.col("keyword_total") >= 1).select("url", "keyword_total")


def _true_positive() -> Column:
    few = F.col("keyword_total").between(1, 2) & (F.col("extension_total") >= 1)
    return (F.col("keyword_total") >= 3) | few


def true_positive_urls(scan: DataFrame) -> DataFrame:
    """URLs with three keyword hits, or fewer beside an extension hit."""
    return scan.where(_true_positive()).select("url", "keyword_total", "extension_total")


def search_summary(url_lists: DataFrame, scan: DataFrame) -> DataFrame:
    """One row: git URLs (repetitions counted), positive and true positive URLs."""
    git = listed_urls(url_lists).agg(F.count_if(F.col("url").contains("git")).alias("git_urls"))
    hits = scan.agg(F.count_if(F.col("keyword_total") >= 1).alias("positive_urls"),
                    F.count_if(_true_positive()).alias("true_positive_urls"))
    rows = git.unionByName(hits, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in ("git_urls", "positive_urls", "true_positive_urls")])

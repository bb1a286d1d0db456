"""Search over the tables `software` and `paper_info` by one or several questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import mentions as mt
from corpusmill.operators import search as se


def _hits(table: DataFrame, field: str, query: str | Sequence[str]) -> DataFrame:
    """(paper, id, score) of the best rows of one column; every row is a document of its own."""
    rows = table.select(F.col("id").alias("doc_id"), F.col(field).alias("text"))
    if isinstance(query, str):
        found = se.cosine_search(rows, query)
    else:
        found = se.multi_query_search(rows, list(query)).select("doc_id", "score")
    of_paper = table.select(F.col("id").alias("doc_id"), F.col("paper_identifier").alias("paper"))
    return se.with_rows(found.distinct(), of_paper).withColumnRenamed("doc_id", "id")


def search_tables(software: DataFrame, paper_info: DataFrame, query: str | Sequence[str]) -> dict[str, DataFrame]:
    """Repositories by description and by name, and the URLs of papers that two searches agree on."""
    described = _hits(software, "repo_description", query)
    named = _hits(software, "repo_name", query)
    titled = _hits(paper_info, "paper_title", query)
    keyed = _hits(paper_info, "paper_keywords", query)
    titles = paper_info.select(F.col("paper_identifier").alias("identifier"), F.col("paper_title").alias("title"))
    links = software.select(F.col("paper_identifier").alias("identifier"), "url", F.col("id").alias("seq"))

    def answers(other: DataFrame) -> DataFrame:
        common = se.intersect_hits(titled, other, "paper").withColumnRenamed("paper", "identifier")
        return mt.lookup_url_lastwins(common, links, titles)

    rows = software.select("id", "paper_identifier", "repo_name", "repo_description", "url")
    return {"repositories": se.with_rows(described.select("id", "score"), rows, "id"),
            "repository_names": se.with_rows(named.select("id", "score"), rows, "id"),
            "titles_and_keywords": answers(keyed), "titles_and_repositories": answers(described)}


def search_titles_and_keywords(mentions: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float],
                               prefilter: int = 20, k: int = 5) -> DataFrame:
    """(title, urls, score): vector search among the best titles and among the best keyword lists, fused.

    `mentions`: (id, title, keywords, urls), `vectors`: (id, embedding). The URLs
    of all mentions with an equal title are returned.
    """
    def near(field: str) -> DataFrame:
        docs = mentions.select("id", F.col(field).alias("text"))
        return se.prefilter_then_rank(docs, query, vectors, query_vector, prefilter, k, "id", "text", "id").select("id", "score")

    fused = se.fuse_avg_score(near("title"), near("keywords"), "id")
    hits = se.with_rows(fused, mentions.select("id", "title"), "id").groupBy("title").agg(F.min("score").alias("score"))
    return mt.join_by_title(hits, mentions)

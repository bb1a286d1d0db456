"""Software mentions, keywords and URLs from paper metadata, and their joins.

Papers have the columns identifier, title, description, category, link,
creator, dates. A row whose text is null is skipped as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.keyphrases import POOL, keyphrases
from corpusmill.session import spool

# The default filters, prompt format and questions.
CATEGORY = "physics:astro-ph"
SUBJECT_PATTERN = "H.E.S.S."
MISSING = "Not specified"
FAILED = "Failed request"
PROMPT_HEAD = "\n                This is the context\n                Context: "
PROMPT_TAIL = (
    "\n    \n                Please answer the following question by extracting parts of the context"
    " and don't elaborate on them.\n                "
)
QUESTIONS = (
    "What region of the sky was or will be observed for this study?",
    "Which data -- and only data, not models -- is used for this analysis?",
    "Which telescopes were used or will be used to observe to collect data?",
)


# -- filters ---------------------------------------------------------------

def filter_category(papers: DataFrame, category: str = CATEGORY) -> DataFrame:
    return papers.where(F.col("category") == category)


def filter_regex(papers: DataFrame, pattern: str = SUBJECT_PATTERN, literal: bool = False,
                 category: str | None = CATEGORY) -> DataFrame:
    """Papers whose description matches; applies together with the category."""
    chosen = papers if category is None else filter_category(papers, category)
    description = F.col("description")
    return chosen.where(description.contains(pattern) if literal else description.rlike("(?d)" + pattern))


def filter_digit_id(rows: DataFrame) -> DataFrame:
    """Rows whose identifier is all digits."""
    return rows.where(F.col("identifier").rlike(tx.DIGITS))


def filter_new_style_id(papers: DataFrame) -> DataFrame:
    """Drop identifiers with a slash; the rest as numbers in `identifier_num`."""
    kept = papers.where(~F.col("identifier").contains("/"))
    return kept.withColumn("identifier_num", F.col("identifier").try_cast("bigint"))


def gate_contains(papers: DataFrame, term: str = "code") -> DataFrame:
    """Papers whose whole description, comment included, holds the term."""
    return papers.where(F.col("description").contains(term))


# -- projections -----------------------------------------------------------

def abstract_bodies(papers: DataFrame) -> DataFrame:
    bodies = papers.select("identifier", tx.strip_comment(F.col("description")).alias("body"))
    return bodies.where(F.col("body").isNotNull())


def titles(papers: DataFrame) -> DataFrame:
    return papers.select("title")


def _source_line():
    parts = [F.col("title")]
    for name in ("link", "creator", "dates"):
        parts += [F.lit("\n"), F.col(name)]
    return F.concat(*parts)


def source_line(papers: DataFrame) -> DataFrame:
    """Title, link, creator and dates as four lines; rows with a null in any are skipped."""
    return papers.select("identifier", _source_line().alias("source")).where(F.col("source").isNotNull())


def raw_texts(papers: DataFrame) -> DataFrame:
    """(identifier, raw_texts): the title as first line, then the body."""
    text = F.concat("title", F.lit("\n"), tx.strip_comment(F.col("description")))
    return papers.select("identifier", text.alias("raw_texts")).where(F.col("raw_texts").isNotNull())


def prompt_fanout(papers: DataFrame, questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """(prompt, response, source): one row per paper and question, response left blank."""
    head = F.concat(F.lit(PROMPT_HEAD), tx.strip_comment(F.col("description")), F.lit(PROMPT_TAIL + "\nQuestion: "))
    rows = papers.select(head.alias("head"), _source_line().alias("source")).where(
        F.col("head").isNotNull() & F.col("source").isNotNull())
    asked = rows.select("head", "source", F.explode(F.array(*[F.lit(q) for q in questions])).alias("question"))
    return asked.select(F.concat("head", "question").alias("prompt"), F.lit("").alias("response"), "source")


# -- mentions --------------------------------------------------------------

def code_mentions(papers: DataFrame, term: str = "code") -> DataFrame:
    """(title, keywords, category, mentioned_software, urls) of papers that name the term.

    Without a URL neither code sentences nor keywords are kept; keywords are
    kept only beside code sentences.
    """
    found = gate_contains(papers, term).withColumn("body", tx.strip_comment(F.col("description"))).select(
        "title", "category", tx.keywords_header(F.col("body")).alias("header"),
        F.when(F.contains("body", F.lit("http")), tx.code_sentences(F.col("body"))).alias("code"),  # of no use without a URL
        tx.extract_urls(F.col("body")).alias("urls"))
    none = F.expr("array()").cast("array<string>")
    has_url, has_code = F.size("urls") > 0, F.size("code") > 0
    return found.select(
        "title", F.when(has_url & has_code, F.coalesce("header", F.lit(""))).otherwise("").alias("keywords"),
        "category", F.when(has_url, F.col("code")).otherwise(none).alias("mentioned_software"), "urls")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id_num", F.col("identifier").try_cast("bigint"))


def semi_identifiers(urls: DataFrame, papers: DataFrame) -> DataFrame:
    """URL rows whose numeric identifier also occurs among the papers."""
    known = filter_new_style_id(papers).select(F.col("identifier_num").alias("id_num"))
    return _numbered(filter_digit_id(urls)).join(known, "id_num", "left_semi").drop("id_num")


def intersect_ids(urls: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct numeric identifiers found on both sides."""
    left = filter_digit_id(urls).select(F.col("identifier").try_cast("bigint").alias("identifier"))
    right = filter_new_style_id(papers).select(F.col("identifier_num").alias("identifier"))
    return left.distinct().intersect(right.distinct())


def first_urls(urls: DataFrame, order: str = "seq") -> DataFrame:
    """(id_num, urls): the first entry of each identifier, combined before the shuffle."""
    return _numbered(filter_digit_id(urls)).groupBy("id_num").agg(F.min_by("url", order).alias("urls"))


def cross_check_mentions(papers: DataFrame, urls: DataFrame, order: str = "seq", top: int = 6) -> DataFrame:
    """(identifier, title, keywords, category, mentioned_software, urls) of papers with a URL entry.

    Keywords are the header list where it stands beside code sentences, else
    the best phrases of the abstract, found in its own row. The first URLs are
    written out, so that their size is known and a hot identifier of the papers
    can be split.
    """
    numbered = filter_new_style_id(papers).where(F.col("identifier_num").isNotNull() & F.col("description").isNotNull())
    body = tx.strip_comment(F.col("description"))
    joined = numbered.select(F.col("identifier_num").alias("id_num"), "title", "category", body.alias("body")).join(
        spool(first_urls(urls, order), "first"), "id_num")
    marked = joined.select(F.col("id_num").alias("identifier"), "title", "category", "body", "urls",
                           tx.keywords_header(F.col("body")).alias("header"), tx.code_sentences(F.col("body")).alias("code"))
    listed = F.col("header").isNotNull() & (F.size("code") > 0)
    phrases = F.transform(keyphrases(F.col("body"), top, pool=POOL), lambda p: p["phrase"])
    keywords = F.when(listed, F.array("header")).otherwise(phrases)
    return marked.select("identifier", "title", keywords.alias("keywords"), "category",
                         F.col("code").alias("mentioned_software"), "urls")


# -- lookups ---------------------------------------------------------------

def join_by_title(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """All URL entries whose title equals a hit's title; hits under a limit are broadcast by their known size."""
    return mentions.select("title", "urls").join(hits, "title")


def lookup_url_lastwins(ids: DataFrame, software: DataFrame, titles: DataFrame, order: str = "seq") -> DataFrame:
    """(identifier, answer): the last URL of each id, or a message naming the title."""
    last = software.groupBy("identifier").agg(F.max_by("url", order).alias("url"))
    missing = F.concat(F.lit("No url was included with the paper title '"), "title", F.lit("'"))
    return ids.distinct().join(titles, "identifier").join(last, "identifier", "left").select(
        "identifier", F.coalesce("url", missing).alias("answer"))


def url_explode(rows: DataFrame, urls: str = "urls", keep: Sequence[str] = ("identifier",)) -> DataFrame:
    """One row per URL of a space-joined list; a null list gives none."""
    return rows.select(*keep, F.posexplode(tx.url_list(F.col(urls))).alias("pos", "url"))


def git_url_flag(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("is_git", F.col(url).contains("git"))


def parse_repo(rows: DataFrame) -> DataFrame:
    """Owner and repository from each URL; rows with too short a path are skipped."""
    return rows.select(*rows.columns, F.inline(F.array_compact(F.array(tx.repo_parts(F.col("url"))))))


def default_missing(repos: DataFrame, default: str = MISSING) -> DataFrame:
    """Null descriptions and languages become a fixed text."""
    return repos.withColumns({c: F.coalesce(c, F.lit(default)) for c in ("description", "language")})


def repo_enrich(mentions: DataFrame, repos: DataFrame) -> DataFrame:
    """(paper_identifier, pos, url, repo_name, repo_description, stars, language, status) per git URL; pos is its place.

    A lookup without a result still gives a row; its text fields say so and
    the number stays null. Of several entries of one repository the one with the
    most stars counts, then the first by its other fields.
    """
    git = parse_repo(url_explode(mentions).where(F.col("url").contains("git")))
    best = F.min(F.struct((-F.col("stars")).alias("order"), "name", "description", "language", "stars")).alias("best")
    single = repos.groupBy("owner", "repo").agg(best).select("owner", "repo", "best.name", "best.description",
                                                             "best.stars", "best.language")
    found = default_missing(single).withColumn("hit", F.lit(True))
    joined = git.join(found, ["owner", "repo"], "left")

    def text(name: str):
        return F.when(F.col("hit"), F.col(name)).otherwise(FAILED)

    return joined.select(
        F.col("identifier").alias("paper_identifier"), "pos", "url", text("name").alias("repo_name"),
        text("description").alias("repo_description"), "stars", text("language").alias("language"),
        F.when(F.col("hit"), "ok").otherwise("failed").alias("status"))


def failed_request_rows(enriched: DataFrame) -> DataFrame:
    return enriched.where(F.col("status") == "failed")


def paper_info_build(mentions: DataFrame) -> DataFrame:
    """(paper_identifier, paper_title, paper_keywords) with the keywords as one text."""
    return mentions.select(F.col("identifier").alias("paper_identifier"), F.col("title").alias("paper_title"),
                           F.array_join("keywords", ",").alias("paper_keywords"))

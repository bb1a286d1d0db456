"""Paper metadata queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.phrases import keyphrases_sql
from checks.registry import check
from checks.search import TERM
from checks.views import duck, table, view
from corpusmill.functions import text as tx
from corpusmill.functions.keyphrases import POOL
from corpusmill.operators import mentions as mt


def papers(spark, sf_dir):
    return view(spark, sf_dir, "papers")


def urls(spark, sf_dir):
    return view(spark, sf_dir, "paper_urls")


SQ = "''"
COLS = "identifier, title, category"
URL = "https?://[$-_a-z!]+"
KW = r"(?:Keywords|KeyWords|keywords):\s*(.+?)(?:[.;]|$)"
CODE = r"(?i)([^.?!]*\b(?:code|software)\b[^.?!]*[.?!])"
BODY = "split_part(description, ';Comment', 1)"
STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
HEADER = f"CASE WHEN regexp_matches(body, '{KW}') THEN trim(regexp_extract(body, '{KW}', 1), {STRIP}) END"


@check("filter_category", duck("papers", f"SELECT {COLS} FROM papers WHERE category = 'physics:astro-ph'"))
def filter_category(spark, sf_dir):
    return mt.filter_category(papers(spark, sf_dir)).select("identifier", "title", "category")


@check("filter_regex", duck("papers", f"SELECT {COLS} FROM papers WHERE category = 'physics:astro-ph' "
                            "AND regexp_matches(description, 'H.E.S.S.')"))
def filter_regex(spark, sf_dir):
    return mt.filter_regex(papers(spark, sf_dir)).select("identifier", "title", "category")


@check("filter_digit_id", duck("paper_urls", "SELECT * FROM paper_urls WHERE regexp_matches(identifier, '^[0-9]+$')"))
def filter_digit_id(spark, sf_dir):
    return mt.filter_digit_id(urls(spark, sf_dir))


@check("filter_new_style_id", duck("papers", "SELECT title, TRY_CAST(identifier AS BIGINT) AS identifier_num "
                                   "FROM papers WHERE NOT contains(identifier, '/')"))
def filter_new_style_id(spark, sf_dir):
    return mt.filter_new_style_id(papers(spark, sf_dir)).select("title", "identifier_num")


@check("strip_comment", duck("papers", f"SELECT doc_id, {BODY} AS body FROM papers"))
def strip_comment(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", tx.strip_comment(F.col("description")).alias("body"))


@check("abstract_bodies", duck("papers", f"SELECT identifier, {BODY} AS body FROM papers"))
def abstract_bodies(spark, sf_dir):
    return mt.abstract_bodies(papers(spark, sf_dir))


@check("titles", duck("papers", "SELECT title FROM papers"))
def titles(spark, sf_dir):
    return mt.titles(papers(spark, sf_dir))


SOURCE = "title || chr(10) || link || chr(10) || creator || chr(10) || dates"


@check("source_line", duck("papers", f"SELECT identifier, {SOURCE} AS source FROM papers WHERE {SOURCE} IS NOT NULL"))
def source_line(spark, sf_dir):
    return mt.source_line(papers(spark, sf_dir))


@check("raw_texts", duck("papers", f"SELECT identifier, title || chr(10) || {BODY} AS raw_texts FROM papers"))
def raw_texts(spark, sf_dir):
    return mt.raw_texts(papers(spark, sf_dir))


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


PROMPT_SQL = f"""SELECT {sql_text(mt.PROMPT_HEAD)} || {BODY} || {sql_text(mt.PROMPT_TAIL)} || chr(10) || 'Question: ' || q AS prompt,
    '' AS response, {SOURCE} AS source
FROM papers CROSS JOIN (SELECT unnest([{', '.join(sql_text(q) for q in mt.QUESTIONS)}]) AS q)
WHERE {SOURCE} IS NOT NULL"""


@check("prompt_fanout", duck("papers", PROMPT_SQL))
def prompt_fanout(spark, sf_dir):
    return mt.prompt_fanout(papers(spark, sf_dir))


@check("gate_contains", duck("papers", f"SELECT {COLS} FROM papers WHERE contains(description, 'code')"))
def gate_contains(spark, sf_dir):
    return mt.gate_contains(papers(spark, sf_dir)).select("identifier", "title", "category")


@check("extract_code_sentences", duck("papers", f"""SELECT doc_id, unnest(regexp_extract_all(body, '{CODE}', 1)) AS sentence
FROM (SELECT doc_id, {BODY} AS body FROM papers)"""))
def extract_code_sentences(spark, sf_dir):
    body = tx.strip_comment(F.col("description"))
    return papers(spark, sf_dir).select("doc_id", F.explode(tx.code_sentences(body)).alias("sentence"))


@check("extract_keywords_header", duck("papers", f"SELECT doc_id, {HEADER} AS keywords FROM "
                                       f"(SELECT doc_id, {BODY} AS body FROM papers)"))
def extract_keywords_header(spark, sf_dir):
    bodies = papers(spark, sf_dir).select("doc_id", tx.strip_comment(F.col("description")).alias("body"))
    return bodies.select("doc_id", tx.keywords_header(F.col("body")).alias("keywords"))


@check("extract_urls", duck("papers", f"SELECT doc_id, unnest(regexp_extract_all({BODY}, '{URL}')) AS url FROM papers"))
def extract_urls(spark, sf_dir):
    body = tx.strip_comment(F.col("description"))
    return papers(spark, sf_dir).select("doc_id", F.explode(tx.extract_urls(body)).alias("url"))


MENTIONS = f"""SELECT title, category,
  CASE WHEN len(u) > 0 AND len(c) > 0 THEN coalesce(header, '') ELSE '' END AS keywords,
  CASE WHEN len(u) > 0 THEN array_to_string(c, '||') ELSE '' END AS mentioned_software,
  array_to_string(u, ' ') AS urls
FROM (SELECT title, category, {HEADER} AS header, regexp_extract_all(body, '{CODE}', 1) AS c,
             regexp_extract_all(body, '{URL}') AS u
      FROM (SELECT *, {BODY} AS body FROM papers WHERE contains(description, 'code')))"""


def flat_mentions(rows):
    return rows.withColumns({"mentioned_software": F.array_join("mentioned_software", "||"),
                             "urls": F.array_join("urls", " ")})


@check("code_mentions", duck("papers", MENTIONS))
def code_mentions(spark, sf_dir):
    return flat_mentions(mt.code_mentions(papers(spark, sf_dir)))


@check("code_mentions_table", duck("papers", f"SELECT title, keywords, category, mentioned_software, urls "
                                   f"FROM ({MENTIONS}) WHERE category = 'physics:astro-ph'"))
def code_mentions_table(spark, sf_dir):
    return flat_mentions(mt.code_mentions(mt.filter_category(papers(spark, sf_dir))))


@check("semi_identifiers", duck("papers paper_urls", """SELECT identifier, url, seq FROM paper_urls
WHERE regexp_matches(identifier, '^[0-9]+$') AND TRY_CAST(identifier AS BIGINT) IN
  (SELECT TRY_CAST(identifier AS BIGINT) FROM papers WHERE NOT contains(identifier, '/'))"""))
def semi_identifiers(spark, sf_dir):
    return mt.semi_identifiers(urls(spark, sf_dir), papers(spark, sf_dir)).select("identifier", "url", "seq")


@check("intersect_ids", duck("papers paper_urls", """SELECT TRY_CAST(identifier AS BIGINT) AS identifier FROM paper_urls
WHERE regexp_matches(identifier, '^[0-9]+$')
INTERSECT SELECT TRY_CAST(identifier AS BIGINT) FROM papers WHERE NOT contains(identifier, '/')"""))
def intersect_ids(spark, sf_dir):
    return mt.intersect_ids(urls(spark, sf_dir), papers(spark, sf_dir))


CROSS = f"""first AS (SELECT TRY_CAST(identifier AS BIGINT) AS idn, arg_min(url, seq) AS urls FROM paper_urls
  WHERE regexp_matches(identifier, '^[0-9]+$') GROUP BY 1),
j AS (SELECT idn AS identifier, title, category, urls, body, {HEADER} AS header,
             regexp_extract_all(body, '{CODE}', 1) AS code
      FROM (SELECT *, TRY_CAST(identifier AS BIGINT) AS idn, {BODY} AS body FROM papers
            WHERE NOT contains(identifier, '/')) JOIN first USING (idn)),
need AS (SELECT identifier, body FROM j WHERE NOT (header IS NOT NULL AND len(code) > 0)),
{keyphrases_sql('body', 'need', 'identifier', pool=POOL)},
ph AS (SELECT identifier, string_agg(phrase, ',' ORDER BY rank) AS phrases FROM best GROUP BY identifier),
cross_checked AS (SELECT j.identifier, title, category, urls, array_to_string(code, '||') AS mentioned_software,
  CASE WHEN header IS NOT NULL AND len(code) > 0 THEN header ELSE coalesce(phrases, '') END AS keywords
  FROM j LEFT JOIN ph USING (identifier))"""


@check("cross_check_mentions", duck("papers paper_urls", f"WITH {CROSS} SELECT * FROM cross_checked"))
def cross_check_mentions(spark, sf_dir):
    rows = mt.cross_check_mentions(papers(spark, sf_dir), urls(spark, sf_dir))
    return rows.withColumns({"mentioned_software": F.array_join("mentioned_software", "||"),
                             "keywords": F.array_join("keywords", ",")})


@check("paper_info_build", duck("papers paper_urls", f"WITH {CROSS} SELECT identifier AS paper_identifier, "
                                "title AS paper_title, keywords AS paper_keywords FROM cross_checked"))
def paper_info_build(spark, sf_dir):
    return mt.paper_info_build(mt.cross_check_mentions(papers(spark, sf_dir), urls(spark, sf_dir)))


LINKED = """linked AS (SELECT title, p.identifier, url AS urls FROM papers p JOIN paper_urls u ON p.identifier = u.identifier)"""


def linked(spark, sf_dir):
    return papers(spark, sf_dir).select("identifier", "title").join(
        urls(spark, sf_dir), "identifier").withColumnRenamed("url", "urls")


@check("join_by_title", duck("papers paper_urls", f"""WITH {LINKED}, hits AS (
  SELECT title, len(title) AS score FROM papers ORDER BY score DESC, title LIMIT 50)
SELECT title, urls, score FROM hits JOIN linked USING (title)"""), ints="score")
def join_by_title(spark, sf_dir):
    ranked = papers(spark, sf_dir).select("title", F.length("title").alias("score"))
    hits = ranked.orderBy(F.col("score").desc(), "title").limit(50)
    return mt.join_by_title(hits, linked(spark, sf_dir))


@check("lookup_url_lastwins", duck("papers paper_urls", """
WITH soft AS (SELECT identifier, arg_max(url, seq) AS url FROM paper_urls WHERE url <> '' GROUP BY identifier)
SELECT identifier, coalesce(url, 'No url was included with the paper title ''' || title || '''') AS answer
FROM papers LEFT JOIN soft USING (identifier)"""))
def lookup_url_lastwins(spark, sf_dir):
    all_papers = papers(spark, sf_dir).select("identifier", "title")
    software = urls(spark, sf_dir).where("url <> ''")
    return mt.lookup_url_lastwins(all_papers.select("identifier"), software, all_papers)


@check("url_explode", duck("paper_urls", """SELECT seq, unnest(string_split(url, ' ')) AS url,
  generate_subscripts(string_split(url, ' '), 1) - 1 AS pos FROM paper_urls"""), ints="pos")
def url_explode(spark, sf_dir):
    return mt.url_explode(urls(spark, sf_dir), "url", ["seq"])


@check("git_url_flag", duck("paper_urls", "SELECT identifier, seq, url, contains(url, 'git') AS is_git FROM paper_urls"))
def git_url_flag(spark, sf_dir):
    return mt.git_url_flag(urls(spark, sf_dir))


PARTS = r"string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '/')"
GIT = ("git AS (SELECT identifier, unnest(string_split(url, ' ')) AS url, "
       "(generate_subscripts(string_split(url, ' '), 1) - 1)::INT AS pos FROM paper_urls)")
PARSED = f"""parsed AS (SELECT identifier, url, p[1] AS owner, p[2] AS repo, pos
  FROM (SELECT *, {PARTS} AS p FROM git WHERE contains(url, 'git')) WHERE len(p) >= 2)"""


@check("parse_repo", duck("paper_urls", f"WITH {GIT}, {PARSED} SELECT * EXCLUDE (pos) FROM parsed"))
def parse_repo(spark, sf_dir):
    exploded = mt.url_explode(urls(spark, sf_dir), "url", ["identifier"])
    return mt.parse_repo(exploded.where(F.col("url").contains("git"))).drop("pos")


@check("default_missing", duck("repos", """SELECT owner, repo, name, coalesce(description, 'Not specified') AS description,
  stars, coalesce(language, 'Not specified') AS language FROM repos"""))
def default_missing(spark, sf_dir):
    return mt.default_missing(view(spark, sf_dir, "repos"))


ENRICH = f"""{GIT}, {PARSED}, enriched AS (SELECT identifier AS paper_identifier, pos, url,
  CASE WHEN r.repo IS NULL THEN 'Failed request' ELSE name END AS repo_name,
  CASE WHEN r.repo IS NULL THEN 'Failed request' ELSE coalesce(description, 'Not specified') END AS repo_description,
  stars, CASE WHEN r.repo IS NULL THEN 'Failed request' ELSE coalesce(language, 'Not specified') END AS language,
  CASE WHEN r.repo IS NULL THEN 'failed' ELSE 'ok' END AS status
  FROM parsed p LEFT JOIN repos r ON p.owner = r.owner AND p.repo = r.repo)"""


def enriched(spark, sf_dir):
    return mt.repo_enrich(urls(spark, sf_dir).withColumnRenamed("url", "urls"), view(spark, sf_dir, "repos"))


@check("repo_enrich", duck("paper_urls repos", f"WITH {ENRICH} SELECT * FROM enriched"))
def repo_enrich(spark, sf_dir):
    return enriched(spark, sf_dir)


@check("failed_request_rows", duck("paper_urls repos", f"WITH {ENRICH} SELECT * FROM enriched WHERE status = 'failed'"))
def failed_request_rows(spark, sf_dir):
    return mt.failed_request_rows(enriched(spark, sf_dir))


@check("parse_list_literal", duck("", r"""SELECT doc_id, array_to_string(CASE WHEN length(lit) <= 2 THEN [] ELSE
    string_split(split_part(substr(lit, 3), ''']', 1), ''', ''') END, '|') AS items
FROM (SELECT doc_id, '[''' || source || ''', ''' || lang || ''', ''' || n_chars || ''']' AS lit FROM documents)"""))
def parse_list_literal(spark, sf_dir):
    literal = F.concat(F.lit("['"), "source", F.lit("', '"), "lang", F.lit("', '"),
                       F.col("n_chars").cast("string"), F.lit("']"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tx.list_literal(literal), "|").alias("items"))


@check("squeeze_spaces", "SELECT doc_id, regexp_replace(replace(text, '.', '   '), ' {2,}', ' ', 'g') AS text FROM documents")
def squeeze_spaces(spark, sf_dir):
    spaced = F.replace("text", F.lit("."), F.lit("   "))
    return table(spark, sf_dir, "documents").select("doc_id", tx.squeeze_spaces(spaced).alias("text"))


@check("newline_marker", "SELECT doc_id, replace(text, chr(10), '[NEWLINE]') AS text FROM documents")
def newline_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.newline_marker(F.col("text")).alias("text"))


@check("capitalize_first", "SELECT doc_id, upper(substr(lower(text), 1, 1)) || substr(lower(text), 2) AS text FROM documents")
def capitalize_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.capitalize_first(F.lower("text")).alias("text"))

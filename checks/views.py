"""Derived views over the given tables, as SQL that reads the same in Spark and DuckDB.

The given tables hold no paper metadata, URL lists, repositories or meeting
minutes, so these views derive them row for row from the whole tables.
`{name}` stands for a table or an earlier view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.readers import parquet_table

TABLES = ("documents", "pages", "part", "conversations", "embeddings", "benchmark", "labels")

PAPERS = """
SELECT doc_id,
       CASE WHEN doc_id % 11 = 0 THEN 'astro-ph/' || CAST(doc_id AS STRING)
            ELSE CAST(doc_id AS STRING) END AS identifier,
       'Paper ' || CAST(doc_id AS STRING) || ' on '
           || replace(split_part(text, '.', 1), chr(10), ' ') AS title,
       text || ' End. '
           || CASE WHEN doc_id % 3 = 0 THEN 'Our Code for item' || CAST(doc_id AS STRING)
                   || ' is public! The software runs anywhere. ' ELSE '' END
           || CASE WHEN doc_id % 2 = 0 THEN 'See https://github.example.org/'
                   || CASE WHEN doc_id % 7 = 0 THEN 'gone' ELSE 'org' || CAST((doc_id * 2) % 5 AS STRING) END
                   || '/repo' || CAST(doc_id * 2 AS STRING) || ', or http://x.org/~me#top. ' ELSE '' END
           || CASE WHEN doc_id % 5 = 0 THEN 'Keywords: gamma rays, item'
                   || CAST(doc_id AS STRING) || '; ' ELSE '' END
           || ';Comment: 12 pages'
           || CASE WHEN doc_id % 4 <> 0 THEN ', code added;Comment: H-E-S-S- data' ELSE '' END AS description,
       CASE WHEN lang = 'en' THEN 'physics:astro-ph' WHEN lang = 'es' THEN NULL ELSE 'math' END AS category,
       'http://archive.example.org/abs/' || CAST(doc_id AS STRING) AS link,
       source AS creator,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            ELSE '2019-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') END AS dates
FROM {documents}
"""

PAPER_URLS = """
SELECT identifier, url, seq FROM (
  SELECT CASE WHEN doc_id % 4 = 3 THEN 'bad-' || CAST(doc_id AS STRING)
              ELSE CAST(doc_id AS STRING) END AS identifier,
         CASE WHEN doc_id % 7 = 0 THEN ''
              ELSE 'https://github.example.org/'
                   || CASE WHEN doc_id % 9 = 1 THEN 'gone' ELSE 'org' || CAST(doc_id % 5 AS STRING) END
                   || '/repo' || CAST(doc_id AS STRING) || '/tree http://site.example.org/'
                   || CAST(doc_id AS STRING) END AS url,
         2 * doc_id AS seq
  FROM {documents}
  UNION ALL
  SELECT CAST(doc_id AS STRING), 'https://gitlab.example.org/late' || CAST(doc_id AS STRING), 2 * doc_id + 1
  FROM {documents} WHERE doc_id % 10 = 0
) u
"""

REPOS = """
SELECT 'org' || CAST(p_partkey % 5 AS STRING) AS owner,
       'repo' || CAST(p_partkey AS STRING) AS repo,
       'repo' || CAST(p_partkey AS STRING) AS name,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END AS description,
       p_size AS stars,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS language
FROM {part}
"""

CONNECTED = """
SELECT doc_id AS text_id,
       'Title ' || CAST(doc_id AS STRING) || chr(10) || 'Intro here. '
       || 'the first long sentence of item ' || CAST(doc_id AS STRING)
       || ' goes on for more than fifty letters'
       || CASE doc_id % 8
            WHEN 0 THEN '. Therefore, ' WHEN 1 THEN '. However, ' WHEN 2 THEN '. Moreover, '
            WHEN 3 THEN '. In other words, ' WHEN 4 THEN '. due to ' WHEN 5 THEN '. A spectroscope is defined as '
            WHEN 6 THEN '. This long opening line is about ' ELSE '. ' END
       || 'the second long sentence of item ' || CAST(doc_id AS STRING)
       || ' also goes on for more than fifty letters. '
       || CASE WHEN doc_id % 4 = 0 THEN 'the third long sentence of item ' || CAST(doc_id AS STRING)
            || ' goes on for more than fifty letters. Thus, the fourth long sentence of the same item is long enough too. '
            || 'the fifth long sentence of item ' || CAST(doc_id AS STRING)
            || ' goes on for more than fifty letters. Hence, the sixth long sentence of the same item is long enough too. '
            ELSE '' END
       || text AS text,
       CASE WHEN lang = 'en' THEN 'domain' ELSE 'general' END AS side
FROM {documents}
"""

# Prose with abbreviations, initials, decimals, quotes, brackets and a bracket that never closes.
PROSE = """
SELECT doc_id AS text_id,
       'Title ' || CAST(doc_id AS STRING) || chr(10)
       || 'Dr. Ann B. Lee of the obs. in Bern found 3.5 keV (cf. fig. ' || CAST(doc_id % 9 AS STRING) || ' and ref. 4) there. "It is seen." '
       || CASE doc_id % 4
            WHEN 0 THEN 'See no. 7 (it is long. It has more.) for e.g. details... and so on. They were there and went. '
            WHEN 1 THEN 'A list ends.' || chr(10) || chr(10) || 'obs. Two of 12. of them? yes! More details follow. It is so long that we went on. '
            WHEN 2 THEN 'Then Prof. Lee (of Bern) went. No. It has been seen at www.site.example.org/a.b by us. '
            ELSE 'Bern is far etc. and the list goes on. "Is it?" he said. [See ref. 2. It is short.] No one has more. ' END
       || text || ' (open. Never closed' AS text
FROM {documents}
"""

URL_LISTS = """
SELECT page_id AS identifier,
       CASE WHEN page_id % 23 = 22 THEN NULL
            ELSE url || CASE WHEN page_id % 4 = 0 THEN ' ' || url || '/git/a ' || url || '/git/b' ELSE '' END END AS urls
FROM {pages}
UNION ALL
SELECT page_id + 1000000000, url || ' http://missing.example.org/' || CAST(page_id AS STRING)
FROM {pages} WHERE page_id % 10 = 0
"""

# Pages with meta tags, `>` in quoted values, capital, unclosed and void tags, quotes that never end.
RICH_PAGES = """
SELECT page_id, url,
       CASE page_id % 5
         WHEN 0 THEN '<DIV TITLE="x>y" data-a=' || chr(39) || '<b>no</b>' || chr(39) || '>shown<IMG alt="a > b" src=x>more</DIV>'
         WHEN 1 THEN '<p don' || chr(39) || 't>it' || chr(39) || 's <a href="u>v"/>here <a title="never>ends>'
         WHEN 2 THEN '<H1 class="a>b">Page <I>number</I> <br/> ' || CAST(page_id AS STRING) || '</H1><b title=">">bold words'
         WHEN 3 THEN '<section><h1>Unclosed words<hr></section><title data-x="</title>">Late &amp; long</TITLE ><i>1 < 2</i>'
         ELSE '' END ||
       replace(html, '<head>', '<head>' || CASE page_id % 4
         WHEN 1 THEN '<meta name="description" content="A &quot;short&quot; text of page ' || CAST(page_id AS STRING) || '">'
         WHEN 2 THEN '<meta content=' || chr(39) || 'Own title ' || CAST(page_id AS STRING) || chr(39)
              || ' property=' || chr(39) || 'og:title' || chr(39) || '/><meta name="description" content="Single">'
         WHEN 3 THEN '<meta charset="x"><META content="caf&#233; &#x41;lpha > &amp;lt; beta" data-b="name=description" NAME=description>'
         ELSE '' END) AS html
FROM {pages}
"""

# One file of minutes per conversation turn; the whole turn is told in its table.
_SAID = "replace(replace(replace(text, chr(10), ' '), '|', '/'), '#', '*')"
_N = "CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)"
MINUTES = f"""
SELECT '/m/' || {_N} || '/operations_call__' || lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0') || '_'
           || lpad(CAST(1 + turn % 12 AS STRING), 2, '0') || '_2024.txt' AS path,
       '# Call ' || {_N} || chr(10) || chr(10) || '## Connection Details' || chr(10)
           || 'Room ' || {_N} || chr(10) || 'pin /hess/secret' || chr(10)
           || CASE WHEN conv_id % 13 = 12 THEN '' ELSE
              '## Attendees' || chr(10) || 'Ann, Bo and the ' || role || '<br>' || chr(10) END
           || '## Operations pages' || chr(10) || 'Current shift workbook: [Shift workbook - S'
           || {_N} || '](/hess/wb' || {_N} || ')' || chr(10)
           || 'Other page /hess/other' || chr(10) || '## Minutes' || chr(10)
           || '| Item | Presenter | Minutes |' || chr(10) || '| --- | --- | --- |' || chr(10)
           || '| OPS intro, [slides](/hess/s' || {_N} || ') | ' || role || ' | <span class="a">' || {_SAID} || '</span><br> |' || chr(10)
           || '| Day shift report | Bo | ' || split_part({_SAID}, '.', 1) || ' |' || chr(10)
           || CASE WHEN turn % 2 = 0 THEN '| HESSIU status | Cy | ' || split_part({_SAID}, '.', 2) || ' |' || chr(10) ELSE '' END
           || '| DAQ status, [slides](/hess/d) |  | <br> |' || chr(10)
           || CASE WHEN turn % 3 = 0 THEN '| FC status | Di | fine |' || chr(10) || '| FC status late | Di | finer |' || chr(10) ELSE '' END
           || '| Pointing | Ed | ' || split_part({_SAID}, '.', 3) || ' |' || chr(10)
           || CASE WHEN turn % 2 = 1 THEN '| Tracking | Ed | ' || split_part({_SAID}, ',', 2) || ' |' || chr(10) ELSE '' END
           || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '| AOB | Cy |  |' || chr(10) END
           || '| Weather |  ||' || chr(10) || CASE WHEN conv_id % 5 = 0 THEN '| Weather | Fay | again |' || chr(10) ELSE '' END
           || '## Next call' || chr(10) || 'Soon' AS text
FROM {{conversations}}
"""

VIEWS = {"papers": PAPERS, "paper_urls": PAPER_URLS, "repos": REPOS, "connected": CONNECTED, "prose": PROSE,
         "url_lists": URL_LISTS, "rich_pages": RICH_PAGES, "minutes": MINUTES}


#: Tables with long rows, which the views work on.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    return parquet_table(spark, f"{sf_dir}/{name}.parquet", deal)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame."""
    text = VIEWS[name]
    sources = {t: table(spark, sf_dir, t, t in TEXTS) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **sources)


def duck(views: str, body: str) -> str:
    """Oracle SQL: the named views (space separated) as leading CTEs, then `body`."""
    body = body.strip()
    ctes = [f"{name} AS ({VIEWS[name].strip().format(**{t: t for t in TABLES})})" for name in views.split()]
    if not ctes:
        return body
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body

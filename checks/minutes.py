"""Meeting minutes queries and their SQL."""

from __future__ import annotations

from checks.registry import check
from checks.views import duck, view
from corpusmill.operators import minutes as mn

STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
MARKUP = "<span[^>]*>|</span>|<br>"
ROW = r"\|(.*?)\|(.*?)\|(.*?)\|"
ALLOWED = ", ".join(f"'{a}'" for a in mn.ALLOWED)
CLEAN = rf"""clean AS (SELECT path, text, regexp_replace(regexp_replace(text,
  '(?s)## Connection Details\n.*?(\n##|\z)', '\1', 'g'), '{MARKUP}', '', 'g') AS cleaned FROM minutes)"""
ENTRIES = rf"""{CLEAN},
sec AS (SELECT path, text, trim(unnest(regexp_split_to_array(cleaned, '## |\n##')), {STRIP}) AS st,
               generate_subscripts(regexp_split_to_array(cleaned, '## |\n##'), 1) AS i FROM clean),
cells AS (SELECT path, i, unnest(regexp_extract_all(text, '{ROW}', 1)) AS a, unnest(regexp_extract_all(text, '{ROW}', 2)) AS b,
                 regexp_replace(unnest(regexp_extract_all(text, '{ROW}', 3)), '{MARKUP}', '', 'g') AS c,
                 generate_subscripts(regexp_extract_all(text, '{ROW}', 1), 1) AS j
          FROM sec WHERE split_part(st, chr(10), 1) = 'Minutes'),
items AS (SELECT path, i * 100000 + j AS pos, trim(regexp_replace(a, ', \[slides\]\(.*?\)', '', 'g'), {STRIP}) AS key,
                 CASE WHEN c <> '' THEN trim(b, {STRIP}) || ', ' || trim(c, {STRIP}) ELSE '' END AS value
          FROM cells WHERE j >= 3),
found AS (SELECT path, i * 100000 AS pos, trim(split_part(st, chr(10), 1), {STRIP}) AS key,
                 CASE WHEN contains(st, chr(10)) THEN trim(substr(st, strpos(st, chr(10)) + 1), {STRIP}) ELSE '' END AS value
          FROM sec WHERE st <> '' AND split_part(st, chr(10), 1) <> 'Minutes'
          UNION ALL SELECT * FROM items),
ent AS (SELECT path, key, arg_max(value, pos) AS value, min(pos) AS pos FROM found GROUP BY path, key)"""


def first_with(part: str, column: str = "value") -> str:
    return f"arg_min({column}, pos) FILTER (WHERE contains(key, '{part}'))"


AOB = f"""coalesce({first_with('AOB')} || ', ' ||
  coalesce(string_agg(key || ': ' || value, ', ' ORDER BY pos) FILTER (WHERE key NOT IN ({ALLOWED})), ''), ' ')"""


def shift(pages: str) -> str:
    line = f"split_part(split_part({pages}, 'Current shift workbook: ', 2), chr(10), 1)"
    return f"split_part(split_part({line}, '[Shift workbook - ', 2), '](', 1)"


DATE = r"strptime(regexp_extract(path, 'operations_call__(\d{2}_\d{2}_\d{4})', 1), '%d_%m_%Y')::DATE"
PAGES = "any_value(value) FILTER (WHERE key = 'Operations pages')"
REPORTS = ", ".join(f"{first_with(part)} AS {name}" for name, part in mn.REPORTS.items())
CALLS = f"""{ENTRIES}, calls AS (SELECT {shift(PAGES)} AS shift_name, {DATE} AS ops_call_date,
  any_value(value) FILTER (WHERE key = 'Attendees') AS attendees, {PAGES} AS ops_pages, {REPORTS}, {AOB} AS aob, path
  FROM ent GROUP BY path)"""


def minutes(spark, sf_dir):
    return view(spark, sf_dir, "minutes")


def sql(select: str, ctes: str = ENTRIES) -> str:
    return duck("minutes", f"WITH {ctes} {select}")


@check("minutes_clean", sql("SELECT path, cleaned FROM clean", CLEAN))
def minutes_clean(spark, sf_dir):
    return mn.minutes_clean(minutes(spark, sf_dir)).select("path", "cleaned")


@check("minutes_urls", sql(r"""SELECT path, unnest(regexp_extract_all(cleaned, '/hess\S+')) AS url,
  generate_subscripts(regexp_extract_all(cleaned, '/hess\S+'), 1) - 1 AS pos FROM clean""", CLEAN), ints="pos")
def minutes_urls(spark, sf_dir):
    return mn.minutes_urls(minutes(spark, sf_dir))


@check("minutes_sections", sql("SELECT path, key, value, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS pos FROM ent"), ints="pos")
def minutes_sections(spark, sf_dir):
    return mn.minutes_sections(minutes(spark, sf_dir))


@check("minutes_table", sql("SELECT path, key, value, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS pos FROM items"), ints="pos")
def minutes_table(spark, sf_dir):
    return mn.minutes_table(minutes(spark, sf_dir))


@check("section_by_substring", sql(f"SELECT path, {first_with('FC', 'key')} AS key, {first_with('FC')} AS value FROM ent GROUP BY path"))
def section_by_substring(spark, sf_dir):
    return mn.section_by_substring(minutes(spark, sf_dir), "FC")


@check("unexpected_keys", sql(f"SELECT path, key FROM ent WHERE key NOT IN ({ALLOWED})"))
def unexpected_keys(spark, sf_dir):
    return mn.unexpected_keys(minutes(spark, sf_dir))


@check("shift_name", sql(f"SELECT path, {shift(PAGES)} AS shift_name FROM ent GROUP BY path"))
def shift_name(spark, sf_dir):
    return mn.shift_name(minutes(spark, sf_dir))


@check("date_from_name", duck("minutes", f"SELECT path, {DATE} AS ops_call_date FROM minutes"))
def date_from_name(spark, sf_dir):
    return mn.date_from_name(minutes(spark, sf_dir))


@check("aob_compose", sql(f"SELECT path, {AOB} AS aob FROM ent GROUP BY path"))
def aob_compose(spark, sf_dir):
    return mn.aob_compose(minutes(spark, sf_dir))


@check("operations_call", sql("SELECT * EXCLUDE (path) FROM calls WHERE attendees IS NOT NULL", CALLS))
def operations_call(spark, sf_dir):
    return mn.operations_call(minutes(spark, sf_dir))


@check("operations_call_rejected", sql("SELECT path FROM calls WHERE attendees IS NULL", CALLS))
def operations_call_rejected(spark, sf_dir):
    return mn.rejected_calls(minutes(spark, sf_dir))


@check("sort_by_date", sql("SELECT * EXCLUDE (path) FROM calls WHERE attendees IS NOT NULL ORDER BY ops_call_date, shift_name", CALLS))
def sort_by_date(spark, sf_dir):
    return mn.sort_by_date(mn.operations_call(minutes(spark, sf_dir)))

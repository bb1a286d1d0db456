"""Meeting minutes, one markdown text per call, to one typed row per call.

Everything about a call is in its own text, so the whole job is column
expressions over the row: no shuffle until the final sort by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bind, strip

# The layout of the minutes.
CONNECTION_BLOCK = r"(?s)## Connection Details\n.*?(?=\n##|\z)"
INLINE_MARKUP = r"<span[^>]*>|</span>|<br>"
SECTION_MARK = "## |\n##"
TABLE_ROW = r"(?d)\|(.*?)\|(.*?)\|(.*?)\|"
SLIDES = r"(?d), \[slides\]\(.*?\)"
URL_PREFIX = "/hess"
ALLOWED = ("OPS intro", "Day shift report", "HESSIU status", "DAQ status", "FC status", "Pointing", "Tracking",
           "AOB", "Attendees", "Operations pages")
REPORTS = {"ops_intro": "OPS intro", "day_shift_report": "Day shift", "hessiu_status": "HESSIU", "fc_status": "FC",
           "daq_status": "DAQ", "tracking": "Tracking", "pointing": "Pointing"}
COLUMNS = ("shift_name", "ops_call_date", "attendees", "ops_pages", "ops_intro", "day_shift_report", "hessiu_status",
           "fc_status", "daq_status", "tracking", "pointing", "aob")


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CONNECTION_BLOCK, ""), INLINE_MARKUP, "")


def minutes_clean(minutes: DataFrame) -> DataFrame:
    """Add `cleaned`: no connection details, no inline markup."""
    return minutes.withColumn("cleaned", _clean(F.col("text")))


def minutes_urls(minutes: DataFrame, prefix: str = URL_PREFIX) -> DataFrame:
    """(path, pos, url): the page paths under a prefix."""
    found = F.regexp_extract_all(_clean(F.col("text")), F.lit(prefix + r"\S+"), F.lit(0))
    return minutes.select("path", F.posexplode(found).alias("pos", "url"))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _table_rows(text: Column) -> Column:
    """array<struct<key, value>>: agenda items of the table, header and rule skipped."""
    def item(row: Column) -> Column:
        cells = [F.regexp_extract(row, TABLE_ROW, i) for i in (1, 2, 3)]
        said = F.regexp_replace(cells[2], INLINE_MARKUP, "")
        value = F.when(said != "", F.concat(strip(cells[1]), F.lit(", "), strip(said))).otherwise("")
        return _entry(strip(F.regexp_replace(cells[0], SLIDES, "")), value)

    rows = F.regexp_extract_all(text, F.lit(TABLE_ROW), F.lit(0))
    return F.transform(bind(rows, lambda r: F.slice(r, 3, F.greatest(F.size(r), F.lit(1)))), item)


def _sections(text: Column) -> Column:
    """array<struct<key, value>> in order; a repeated key keeps its first place and last value."""
    def entries(section: Column) -> Column:
        key = F.substring_index(section, "\n", 1)
        body = F.when(F.contains(section, F.lit("\n")), strip(F.substr(section, F.length(key) + 2))).otherwise("")
        return F.when(key != "Minutes", F.array(_entry(strip(key), body))).otherwise(_table_rows(text))

    parts = F.filter(F.transform(F.split(_clean(text), SECTION_MARK), strip), lambda s: s != "")
    found = F.flatten(F.transform(parts, entries))

    def last_wins(all_entries: Column) -> Column:
        keys = F.array_distinct(F.transform(all_entries, lambda e: e["key"]))
        return F.transform(keys, lambda k: _entry(
            k, F.element_at(F.filter(all_entries, lambda e: e["key"] == k), -1)["value"]))

    return bind(found, last_wins)


def minutes_sections(minutes: DataFrame) -> DataFrame:
    """(path, pos, key, value): sections and agenda items of each call."""
    rows = minutes.select("path", F.posexplode(_sections(F.col("text"))).alias("pos", "entry"))
    return rows.select("path", "pos", "entry.key", "entry.value")


def minutes_table(minutes: DataFrame) -> DataFrame:
    """(path, pos, key, value): agenda items of the table alone."""
    rows = minutes.select("path", F.posexplode(_table_rows(F.col("text"))).alias("pos", "entry"))
    return rows.select("path", "pos", "entry.key", "entry.value")


def by_substring(entries: Column, part: str) -> Column:
    """First entry whose key holds `part`; null when there is none."""
    return F.try_element_at(F.filter(entries, lambda e: F.contains(e["key"], F.lit(part))), F.lit(1))


def _exact(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(1))["value"]


def section_by_substring(minutes: DataFrame, part: str) -> DataFrame:
    """(path, key, value) of the first section whose title holds `part`."""
    found = minutes.select("path", by_substring(_sections(F.col("text")), part).alias("entry"))
    return found.select("path", "entry.key", "entry.value")


def unexpected_keys(minutes: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(path, key): section titles outside the allowed list."""
    odd = F.filter(_sections(F.col("text")), lambda e: ~e["key"].isin(*allowed))
    return minutes.select("path", F.explode(odd).alias("entry")).select("path", "entry.key")


def _after(text: Column, mark: str) -> Column:
    """What follows the first `mark` up to the next one; null without a mark."""
    return F.try_element_at(F.split(text, mark, -1), F.lit(2))


def shift_name_of(pages: Column) -> Column:
    line = F.substring_index(_after(pages, r"Current shift workbook: "), "\n", 1)
    return F.substring_index(_after(line, r"\[Shift workbook - "), "](", 1)


def call_date_of(path: Column) -> Column:
    stamp = F.substring_index(_after(path, "operations_call__"), ".txt", 1)
    return F.try_to_timestamp(F.replace(stamp, F.lit("_"), F.lit("-")), F.lit("dd-MM-yyyy")).cast("date")


def shift_name(minutes: DataFrame) -> DataFrame:
    pages = _exact(_sections(F.col("text")), "Operations pages")
    return minutes.select("path", shift_name_of(pages).alias("shift_name"))


def date_from_name(minutes: DataFrame) -> DataFrame:
    return minutes.select("path", call_date_of(F.col("path")).alias("ops_call_date"))


def _aob(entries: Column, allowed: tuple[str, ...]) -> Column:
    odd = F.filter(entries, lambda e: ~e["key"].isin(*allowed))
    listed = F.array_join(F.transform(odd, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return F.coalesce(F.concat(by_substring(entries, "AOB")["value"], F.lit(", "), listed), F.lit(" "))


def aob_compose(minutes: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(path, aob): other business followed by unexpected sections; one space without it."""
    parsed = minutes.select("path", _sections(F.col("text")).alias("entries"))
    return parsed.select("path", _aob(F.col("entries"), allowed).alias("aob"))


def _parsed_calls(minutes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    entries = F.col("entries")
    parsed = minutes.select("path", _sections(F.col("text")).alias("entries"))
    read = parsed.withColumns({
        "attendees": _exact(entries, "Attendees"), "ops_pages": _exact(entries, "Operations pages"),
        "ops_call_date": call_date_of(F.col("path")), "aob": _aob(entries, allowed),
        **{name: by_substring(entries, part)["value"] for name, part in REPORTS.items()}})
    return read.withColumn("shift_name", shift_name_of(F.col("ops_pages")))


def _complete() -> Column:
    needed = [F.col(c).isNotNull() for c in ("attendees", "ops_pages", "shift_name", "ops_call_date")]
    return needed[0] & needed[1] & needed[2] & needed[3]


def _where_parsed(calls: DataFrame, condition: Column, columns: tuple[str, ...]) -> DataFrame:
    """Keep rows by a condition on parsed columns.

    A plain filter would be pushed below the parsing and parse every text
    again; a row given out as an array of one or none is not.
    """
    return calls.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def operations_call(minutes: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The typed table, one row per complete call."""
    return _where_parsed(_parsed_calls(minutes, allowed), _complete(), COLUMNS)


def rejected_calls(minutes: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Paths of calls without attendees, operations pages, shift name or date."""
    return _where_parsed(_parsed_calls(minutes, allowed), ~_complete(), ("path",))


def sort_by_date(calls: DataFrame) -> DataFrame:
    return calls.orderBy("ops_call_date", "shift_name")

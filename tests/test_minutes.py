from __future__ import annotations

import datetime

from conftest import rows
from corpusmill.operators import minutes as mn

GOOD = """# Call

## Connection Details
Room /hess/secret

## Attendees
Ann<br>
## Operations pages
Current shift workbook: [Shift workbook - S7](/hess/wb7)
## Minutes
| Item | Presenter | Minutes |
| --- | --- | --- |
| OPS intro, [slides](/hess/s) | Bo | <span style="x">fine</span> |
| FC status | Cy | |
| AOB | Di | tea |
| Two | cells
| Odd | E ||
## AOB
late
## Empty
"""


def minutes(spark, *texts):
    return spark.createDataFrame([(f"/m/operations_call__{i + 1:02d}_04_2024.txt", t) for i, t in enumerate(texts)],
                                 "path string, text string")


def test_sections_and_items(spark):
    got = [(r["key"], r["value"]) for r in mn.minutes_sections(minutes(spark, GOOD)).orderBy("pos").collect()]
    assert got == [
        ("# Call", ""), ("Attendees", "Ann"),
        ("Operations pages", "Current shift workbook: [Shift workbook - S7](/hess/wb7)"),
        ("OPS intro", "Bo, fine"), ("FC status", "Cy, "), ("AOB", "late"), ("Odd", ""), ("Empty", "")]


def test_the_typed_row(spark):
    call = mn.operations_call(minutes(spark, GOOD)).first()
    assert call["shift_name"] == "S7" and call["ops_call_date"] == datetime.date(2024, 4, 1)
    assert call["ops_intro"] == "Bo, fine" and call["daq_status"] is None
    assert call["aob"] == "late, # Call: , Odd: , Empty: "


def test_incomplete_calls_are_set_aside(spark):
    texts = minutes(spark, GOOD, "no sections at all", GOOD.replace("## Attendees\nAnn<br>\n", ""),
                    GOOD.replace("Current shift workbook", "Other"), None)
    assert [r["shift_name"] for r in mn.operations_call(texts).collect()] == ["S7"]
    assert len(rows(mn.rejected_calls(texts))) == 4


def test_without_other_business_there_is_one_space(spark):
    text = "## Attendees\nAnn\n## Minutes\n|a|b|c|\n|-|-|-|\n"
    assert rows(mn.aob_compose(minutes(spark, text)).select("aob")) == [(" ",)]


def test_a_wrong_date_is_null(spark):
    bad = spark.createDataFrame([("/m/operations_call__31_02_2024.txt", "x"), ("/m/other.txt", "x")], "path string, text string")
    assert rows(mn.date_from_name(bad).select("ops_call_date")) == [(None,), (None,)]


def test_urls_outside_the_connection_block(spark):
    got = [r["url"] for r in mn.minutes_urls(minutes(spark, GOOD)).orderBy("pos").collect()]
    assert got == ["/hess/wb7)", "/hess/s)"]

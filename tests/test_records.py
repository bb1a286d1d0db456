"""Records with line breaks inside quoted cells, cut anywhere into splits."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import readers
from corpusmill.sources.records import records

CELLS = ["", "plain", "two words", 'in "quotes"', "line\nbreak", "\n", 'a "b\nc" d', "x,y", "t\tt", '"', "ends\n", "é\n\n€", '""', ",\n,", " lead"]


def write(path, sep, rows):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")
    writer.writerow(["identifier", "a", "b"])
    writer.writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8")


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "900b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_every_split_gives_the_rows_of_the_whole_file(spark, tmp_path, small_splits, sep):
    lots = random.Random(3)
    wanted = []
    folder = tmp_path / "data"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        rows = [(f"{name}{i}", lots.choice(CELLS), lots.choice(CELLS) + ("long\n" * 300 if i == 50 else "")) for i in range(150)]
        write(folder / name, sep, rows)
        wanted += rows
    schema = "identifier STRING, a STRING, b STRING"
    cut = records(spark, str(folder), sep)
    assert cut.select("file", "block").distinct().count() > 8 and cut.where("header").count() == 2
    if sep == ",":
        got = readers.csv_dataset(spark, str(folder), schema)
    else:
        got = readers.abstracts_tsv(spark, str(folder), ("identifier", "a", "b"))
    got = {r["identifier"]: (r["a"], r["b"]) for r in got.collect()}
    assert set(got) == {r[0] for r in wanted}
    # Like the built-in reader of whole files: an empty cell is null, blanks at the ends stay or go as it has them.
    plain = {r["identifier"]: (r["a"], r["b"]) for r in spark.read.schema(schema).csv(
        str(folder), sep=sep, header=True, multiLine=True, quote='"', escape='"').collect()}
    assert got == plain
    assert {i: tuple(v or "" for v in row) for i, row in got.items()} == {i: (a, b) for i, a, b in wanted}


def test_order_is_that_of_the_files(spark, tmp_path, small_splits):
    rows = [(f"{i:04d}", "x\ny" if i % 7 == 0 else "x" * (i % 50), "z") for i in range(400)]
    write(tmp_path / "t.tsv", "\t", rows)
    found = readers.abstracts_tsv(spark, str(tmp_path / "t.tsv"), ("identifier", "a", "b"), order="place").orderBy("place")
    assert [r["identifier"] for r in found.collect()] == [r[0] for r in rows]


def test_quotes_within_plain_cells_open_nothing(spark, tmp_path, small_splits):
    text = "identifier,a,b\n" + "".join(f'{i},5" disk,"say ""hi"", {i}"\n' for i in range(100)) + '100,x,"never closed\nstill'
    (tmp_path / "q.csv").write_text(text)
    found = readers.csv_dataset(spark, str(tmp_path / "q.csv"), "identifier STRING, a STRING, b STRING")
    assert found.where(F.col("a") == '5" disk').count() == 100 and found.count() == 101
    assert found.where("identifier = '7'").first()["b"] == 'say "hi", 7'


def test_empty_files_and_blank_lines(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("identifier,a,b\n\n1,2,3\n\n")
    assert [tuple(r) for r in readers.csv_dataset(spark, str(tmp_path), "identifier STRING, a STRING, b STRING").collect()] == [("1", "2", "3")]

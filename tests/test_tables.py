from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpusmill.operators import splits as sp
from corpusmill.operators import tables as tb
from corpusmill.sources import readers, writers


def numbers(spark, n=1000):
    return spark.range(n).select((F.col("id") * 7 % n).alias("k")).repartition(8)


def test_row_ids_are_consecutive_in_key_order(spark):
    got = tb.row_ids(numbers(spark), "k").collect()
    assert sorted(r["id"] for r in got) == list(range(1, 1001))
    assert all(r["id"] == r["k"] + 1 for r in got)


def test_row_ids_of_one_key_only(spark):
    same = spark.range(500).select(F.lit("hot").alias("k"), "id")
    assert sorted(r["n"] for r in tb.row_ids(same, "k", "id", name="n").collect()) == list(range(1, 501))


def test_skip_take(spark):
    assert rows(tb.skip_take(numbers(spark), "k", 10, 3)) == [(10,), (11,), (12,)]
    assert tb.skip_take(numbers(spark), "k", 990).count() == 10
    assert tb.skip_take(numbers(spark), "k", 0, 0).count() == 0


def test_checks(spark):
    t = spark.createDataFrame([(1, None), (1, "b"), (2, "c")], "k int, v string")
    assert rows(tb.check_not_null(t, ("k", "v"))) == [(0, 1)]
    assert rows(tb.check_unique_key(t, "k")) == [(1, 2)]
    assert rows(tb.table_preview_widths(t, 3)) == [(1, 3)]


def test_months(spark):
    m = spark.createDataFrame([("9801",), ("0712",), ("0712",), ("2403",)], "yymm string")
    assert [tuple(r) for r in tb.distinct_years(m).collect()] == [("98", "1998"), ("07", "2007"), ("24", "2024")]
    assert {r["yymm"]: r["running"] for r in tb.running_rows(m).collect()} == {"9801": 1, "0712": 3, "2403": 4}


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_parts_have_exact_sizes_whatever_the_keys(spark, n):
    """Unique keys, one key for a third of the rows, null and empty keys, equal rows; any partitioning gives the same parts."""
    values = [(None if i % 50 == 1 else "" if i % 50 == 2 else "hot" if i % 3 == 0 else f"k{i}", i % 2) for i in range(n)]
    given = spark.createDataFrame(values, "k string, v int")
    parts = [rows(f(given.repartition(p))) for f in (lambda d: sp.split_train_val_test(d, "k"), lambda d: sp.shard(d, "k", 4)) for p in (1, 7)]
    assert parts[0] == parts[1] and parts[2] == parts[3]
    assert sorted(map(repr, (r[:2] for r in parts[0]))) == sorted(map(repr, values))
    n_test = -(-n // 5)
    n_validation = -(-(n - n_test) // 4)
    sizes = Counter(r[2] for r in parts[0])
    assert (sizes["test"], sizes["validation"], sizes["train"]) == (n_test, n_validation, n - n_test - n_validation)
    even = Counter(r[2] for r in parts[2])
    assert all(n // 4 <= even[i] <= -(-n // 4) for i in range(4)) and sum(even.values()) == n


def test_splits_are_stable_and_about_the_right_size(spark):
    first = rows(sp.split_train_val_test(numbers(spark), "k"))
    again = rows(sp.split_train_val_test(numbers(spark).repartition(3), "k"))
    assert first == again
    sizes = {s: sum(1 for r in first if r[1] == s) for s in ("train", "validation", "test")}
    assert abs(sizes["train"] - 600) < 60 and abs(sizes["validation"] - 200) < 50 and abs(sizes["test"] - 200) < 50
    assert {r[1] for r in rows(sp.split_train_test(numbers(spark), "k", None))} == {"train"}


def test_shards_are_even(spark):
    counts = [r["count"] for r in sp.shard(numbers(spark), "k", 4).groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) < 80


def test_ragged_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(
        "identifier\ttitle\tdescription\tcategory\tlink\tcreator\tdates\n"
        "1\tt\td\tc\tl\tcr\tda\n2\tt\td\n3\tt\td\tc\tl\tcr\tda\textra\n4\tt\td\tc\tl\tcr\tda\t\n5\t\td\tc\tl\tcr\tda\n")
    got = {r["identifier"]: r for r in readers.abstracts_tsv(spark, str(tmp_path / "a.tsv")).collect()}
    assert set(got) == {"1", "2", "5"}
    assert got["2"]["category"] is None and got["5"]["title"] is None


def test_empty_url_cells_stay_empty_texts(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("1\thttp://a http://b\n2\t\n3\n4\tx\ty\n")
    assert rows(readers.url_list(spark, str(tmp_path / "u.tsv"))) == [("1", "http://a http://b"), ("2", ""), ("3", "")]


def test_csv_round_trip_keeps_line_breaks_quotes_and_spaces(spark, tmp_path):
    data = [("1", 'a "quoted"\nline, two '), ("2", " lead"), ("3", None)]
    df = spark.createDataFrame(data, "identifier string, raw_texts string")
    path = writers.write_csv(df, str(tmp_path / "c"))
    assert rows(readers.csv_dataset(spark, path, "identifier STRING, raw_texts STRING")) == sorted(data, key=repr)


def test_layouts(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.page_inputs(spark, str(tmp_path), "other")


def test_tables_are_replaced_and_typed(spark, tmp_path):
    calls = spark.createDataFrame([("S1", "2024-04-25")], "shift_name string, ops_call_date string")
    for i in range(2):
        name = writers.replace_table(calls, "operations_call", str(tmp_path / f"t{i}"))
    got = readers.table_scan(spark, name)
    assert got.count() == 1 and got.schema["ops_call_date"].dataType.simpleString() == "date"
    with pytest.raises(NameError):
        writers.replace_table(calls, "other")


def test_a_refused_write_leaves_the_old_rows(spark, tmp_path):
    info = spark.createDataFrame([(i, i, f"t{i}", "k") for i in range(20)], "id int, paper_identifier long, paper_title string, paper_keywords string")
    writers.replace_table(info, "paper_info", str(tmp_path / "p"))
    for wrong in (info.unionByName(info), info.withColumn("paper_title", F.lit(None).cast("string")),
                  info.withColumn("paper_title", F.raise_error(F.lit("broken")).cast("string"))):
        with pytest.raises(Exception, match="refuses|broken"):
            writers.replace_table(wrong, "paper_info", str(tmp_path / "p"))
        assert readers.table_scan(spark, "paper_info").count() == 20
    writers.replace_table(info.where("id < 3"), "paper_info", str(tmp_path / "p"))
    assert rows(readers.table_scan(spark, "paper_info").select("id")) == [(0,), (1,), (2,)]


def test_stored_tables_join_without_a_shuffle(spark, tmp_path, capsys):
    info = spark.createDataFrame([(i, i, f"t{i}", "k") for i in range(50)], "id int, paper_identifier long, paper_title string, paper_keywords string")
    software = spark.createDataFrame([(i, f"u{i}", "r", "d", i, "l", i % 50) for i in range(200)],
                                     "id int, url string, repo_name string, repo_description string, stars int, language string, paper_identifier long")
    writers.replace_table(info, "paper_info", str(tmp_path / "p"))
    writers.replace_table(software, "software", str(tmp_path / "s"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = readers.table_scan(spark, "software").drop("id").join(readers.table_scan(spark, "paper_info"), "paper_identifier")
        joined.explain()
        assert joined.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in capsys.readouterr().out


def test_names_carry_options():
    assert writers.option_name("dataset", True, False, 5, 10) == "dataset_astroph1_hess0_skiprows5_maxrows10"


def test_folders_are_gathered_before_the_write(spark, tmp_path):
    import glob

    many = sp.shard(numbers(spark).repartition(50), "k", 4)
    path = writers.write_splits(many, str(tmp_path / "s"), ("shard",))
    assert spark.read.parquet(path).count() == 1000
    assert len(glob.glob(path + "/shard=*/*.parquet")) < 20

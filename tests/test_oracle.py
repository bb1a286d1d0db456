"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import io
import sys
from contextlib import redirect_stdout
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry  # noqa: E402
from tools.compare import connect, normal  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()
OWN = list(spark_entry.QUERIES)  # those of the optional package have tests of their own

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", OWN)
def test_same_rows_without_cross_joins_and_python(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    text = plan(df)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in text
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    rows = cursor.fetchall()
    assert got == normal([d[0] for d in cursor.description], rows)


def test_entry_gives_rows(spark):
    assert spark_entry.entry(spark).count() > 0

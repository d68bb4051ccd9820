"""Every registered query against its expected result on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from check import rows
from pageframe.plans.queries import QUERIES as pageframe_queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    return connection


OWN = sorted(pageframe_queries)


def test_every_query_has_an_expected_result():
    assert set(OWN) <= set(entry.queries())
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 50

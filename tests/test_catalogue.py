"""Every registered query against its SQL, over whole tables of the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return con


def rows_of(frame):
    def plain(value):
        if value is None or value != value:
            return "null"
        return f"{round(float(value), 5) + 0.0:.5f}" if isinstance(value, float) else str(value)

    return sorted(tuple(map(plain, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, oracle, name):
    own = entry.queries()[name](spark, SF_DIR).toPandas()
    expected = oracle.execute(entry.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(expected.columns)
    assert rows_of(own) == rows_of(expected)


@pytest.mark.parametrize("name", sorted(set(entry.CATALOGUE) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    # The smallest scale's series has no shape of the planted period.
    frame = entry.queries()[name](spark, SF_DIR.replace("sf0.001", "sf0.01"))
    assert frame.columns and frame.count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

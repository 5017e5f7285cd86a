"""Every registered query with a DuckDB twin gives the twin's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strophe.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(ORACLE[name])
    named = [x[0] for x in result.description]
    theirs = sorted(tuple(repr(r[named.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted(named) == cols
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

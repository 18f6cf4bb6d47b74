"""Every query with a SQL twin, run beside DuckDB on the smallest tables."""

import pytest
from check_oracle import connect, rows_of

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "bars_above", "n_buy", "buy_share"]
    assert df.count() == 5

"""Every query with oracle SQL equals DuckDB on the same parquet tables."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import rows_of

from conftest import SF_SMALL

# The optional training-data queries (op*) have their own tests in tests/llm.
SQL = {k: v for k, v in E.oracle_sql().items() if not k.startswith("op")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL, SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows_of(got) == rows_of(want)


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[:2] == ["dept", "total_tickets"]

"""Training-data queries with SQL equal DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from slaframe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def cells(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in row)
                        for row in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert cells(QUERIES[name](spark, SF).toPandas()) == cells(con.execute(ORACLE_SQL[name]).df())

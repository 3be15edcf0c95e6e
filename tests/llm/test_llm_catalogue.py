"""Every query of the subpackage runs; those with SQL agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from pagemill.llm import catalogue
from tests.conftest import DATA

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name in SQL:
        con = duckdb.connect()
        for table in ("page_data", "documents", "benchmark"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        result = con.sql(SQL[name])
        assert sorted(result.columns) == columns
        assert found == sorted(repr(r) for r in result.select(*(f'"{c}"' for c in columns)).fetchall())

"""Every query runs; those with SQL agree with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pagemill.plans import catalogue
from tests.conftest import DATA

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in SQL:
        result = duck.sql(SQL[name])
        assert sorted(result.columns) == columns
        assert found == sorted(tuple(map(plain, r)) for r in result.select(*(f'"{c}"' for c in columns)).fetchall())


def test_nothing_outside_needs_the_llm_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(catalogue.__file__)))
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "pagemill.llm" not in source.read()

"""Every query with SQL equals it in DuckDB."""

import os

import duckdb
import pytest

from embralign.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("null" if v is None or v != v else v if isinstance(v, str) else str(round(float(v), 4)) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(catalogue.SQL[name]).df())

"""Each query of the catalog against its SQL on the small tables."""

import duckdb
import pytest

from weftgraph import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    found = sorted(tuple(map(norm, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    assert found == sorted(tuple(map(norm, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r["type"] for r in __spark_entry__.entry(spark).collect()} == {"Region", "Nation", "Supplier", "Customer", "Part", "Order"}

"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from assetloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("part", "orders", "events", "documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    rows = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert mine == sorted((tuple(map(plain, r)) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_entry_without_subpackage():
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())

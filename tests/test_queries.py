"""Every query with SQL against that SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from quillpack import registry

DATA = os.environ.get("QUILLPACK_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("nation", "customer", "part", "orders", "lineitem", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    made = registry.queries()[name](spark, DATA)
    columns = sorted(made.columns)
    got = sorted((plain(tuple(r)) for r in made.select(*columns).collect()), key=repr)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(plain, found), key=repr)
    assert got


def test_entry_points(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

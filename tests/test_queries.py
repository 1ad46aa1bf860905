"""Every registered query against its SQL on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as contract
from sedimenta.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    result = duck.execute(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    shown = [c[0] for c in result.description]
    assert sorted(shown) == columns
    order = [shown.index(c) for c in columns]
    want = collections.Counter(tuple(row[i] for i in order) for row in result.fetchall())
    got = collections.Counter(tuple(row[c] for c in columns) for row in df.collect())
    assert got == want and got


def test_entry(spark):
    assert contract.entry(spark).count() > 0

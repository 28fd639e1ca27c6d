"""Every graph query against its SQL, and the driver's three functions."""

import duckdb
import pytest

import __spark_entry__
from groundwalk.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(row[c] for c in columns) for row in df.collect())
    found = tables.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    assert got == sorted(tuple(row[names.index(c)] for c in columns) for row in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

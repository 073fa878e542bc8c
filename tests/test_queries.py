import os

import pytest

from codrel.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    ran = oracle.execute(ORACLE_SQL[name])
    columns, expected = [c[0] for c in ran.description], ran.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = df.select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 34
    assert set(contract.oracle_sql()) <= set(contract.queries())

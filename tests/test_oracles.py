import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.own.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = __spark_entry__.own.QUERIES[name](spark, SF)
    got = df.collect()
    found = tables.execute(__spark_entry__.own.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got), key=key)
    theirs = sorted((tuple(plain(v) for v in r) for r in want), key=key)
    assert mine == theirs and len(mine) > 0

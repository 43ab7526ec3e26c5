"""Every query beside its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from cartolith import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want)) and (want or name in ("join_anti", "filter_literal"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())

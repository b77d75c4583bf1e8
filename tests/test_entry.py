"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from curvespark.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    tidy = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(tidy, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), sql.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

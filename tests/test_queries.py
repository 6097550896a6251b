"""Every query with an SQL equivalent gives DuckDB's rows."""

import os

import duckdb
import pandas as pd
import pytest

from tastegraph.operators.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    text = lambda x: "null" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return sorted(tuple(text(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_no_own_group_and_at_most_k(spark):
    got = QUERIES["co_occurrence"](spark, DATA).toPandas()
    assert got.groupby("item_id").size().max() <= 30 and (got["item_id"] != got["similar_id"]).all()


def test_sample_takes_each_user_once(spark):
    got = QUERIES["stratified_sample"](spark, DATA).toPandas()
    assert len(got) and got["user_id"].is_unique and got["ord"].is_unique


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

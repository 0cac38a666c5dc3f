"""Every engine query against its SQL, and under another partitioning."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from thicket import queries as engine

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if hasattr(v, "item") and float(v).is_integer() else v
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, name):
    got = rows(engine.queries()[name](spark, DATA).toPandas())
    assert got and got == rows(duck.sql(engine.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["call_edges", "resolve_dependencies", "inside_join", "overlap_inner"])
def test_partitioning_changes_nothing(spark, name):
    a = rows(engine.queries()[name](spark, DATA).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(engine.queries()[name](spark, DATA).toPandas()) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(engine.oracle_sql()) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())

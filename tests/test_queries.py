"""Every query of the core registry against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from sievework.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["o_orderkey", "o_totalprice"]


def test_semijoin_plans(spark):
    plan = lambda name: QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ExistenceJoin" in plan("match_exists_or_field")
    assert "LeftAnti" in plan("match_not_exists")
    assert "LeftSemi" in plan("match_same_child_all_criteria")
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan("match_same_child_all_criteria")

"""Every registered query with an oracle gives what DuckDB gives on the same tables."""

import os

import pytest

from tramline.plans import driver_queries, footage_queries, function_queries, writing_queries

DIR = "/root/testdata/sf0.001"
QUERIES = driver_queries.QUERIES | function_queries.QUERIES | footage_queries.QUERIES | writing_queries.QUERIES
ORACLES = driver_queries.ORACLES | function_queries.ORACLES | footage_queries.ORACLES | writing_queries.ORACLES


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def norm(v):
    return round(v, 4) if isinstance(v, float) else v


def rows(names, found):
    return sorted((tuple(norm(r[n]) for n in names) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    assert rows(names, df.collect()) == rows(names, [dict(zip(want.columns, r)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, duck, name):
    assert QUERIES[name](spark, DIR).count() > 0

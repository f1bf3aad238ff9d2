"""Text queries with an oracle give what DuckDB gives on the same tables."""

import os

import pytest

from tramline.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = con.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    key = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in key) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_a_query(n):
    assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1

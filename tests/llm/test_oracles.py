"""The subpackage's queries against their SQL on the two smallest tables."""

import os

import pytest

from overfly.llm import queries

duckdb = pytest.importorskip("duckdb")
TABLES = ("documents", "embeddings", "labels")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name, size):
    data = f"/root/testdata/{size}"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    rel = c.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted(tuple(plain(dict(zip(rel.columns, r))[k]) for k in cols) for r in rel.fetchall())
    assert sorted(tuple(plain(r[k]) for k in cols) for r in df.collect()) == want

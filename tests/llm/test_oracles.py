"""Registered queries against their SQL on the same tables."""

import duckdb
import pytest

from tidewire.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_its_sql(work, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](work, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)

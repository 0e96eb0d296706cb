"""Every registered query against its SQL, run by another engine on the same tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tidewire.plans.oracles import ORACLES
from tidewire.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        return "" if value is None else value.isoformat() if hasattr(value, "isoformat") else repr(value)

    return sorted(tuple(text(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, sf, engine, name):
    df = queries()[name](spark, sf)
    result = engine.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["id", "datetime", "schema_name", "rawdata"] and df.count() == 350

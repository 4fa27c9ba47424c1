"""Every registered query against its SQL twin on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from spotrace.checks import registry

FOLDER = os.environ.get("SPOTRACE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("customer", "embeddings", "events", "lineitem", "nation", "orders", "supplier")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    sql = registry.SQL[name]
    quoted = ", ".join(f'"{c}"' for c in columns)
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    want = sorted(duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall(), key=repr)
    assert got == want


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["datum", "trace_num", "changepoints"] and df.count() > 0


def test_keys_agree():
    assert set(registry.SQL) == set(registry.QUERIES) <= set(spark_entry.queries())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())

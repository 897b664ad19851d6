"""Every query beside its SQL on the smallest tables, and the shape of those that have none."""

import os

import duckdb
import pytest

from tessera.plans import registry

from .compare import plain

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in os.listdir(small):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, small, duck):
    found = registry.queries()[name](spark, small).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns) and len(found)
        return
    expected = duck.sql(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected)


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1

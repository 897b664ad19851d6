"""Named queries over a folder of Parquet tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return keep


def catalog_query(name: str, sql: str | None = None):
    """Register a function of a Catalog; its SQL may name the catalog's tables."""
    from tessera.sources.fixtures import Catalog, with_tables

    def keep(function):
        query(name, with_tables(sql) if sql else None)(lambda spark, sf_dir: function(Catalog(spark, sf_dir)))
        return function

    return keep


def queries() -> dict[str, Query]:
    from tessera.plans import catalogue  # noqa: F401  registers on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)

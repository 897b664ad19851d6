"""Changes of a table as new snapshots: DataFrames in, the whole new table out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows whose key is there replace the update columns, nulls included; the others are added.

    rows has one row for each key. Columns that it lacks keep their value, or are null in added rows.
    """
    old, new = table.withColumn("__o", F.lit(True)).alias("o"), rows.withColumn("__w", F.lit(True)).alias("w")
    there = F.col("w.__w").isNotNull()
    columns = []
    for c in table.columns:
        if c in keys:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"w.{c}")).alias(c))
        elif c not in rows.columns:
            columns.append(F.col(f"o.{c}"))
        elif c in update:
            columns.append(F.when(there, F.col(f"w.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("o.__o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"w.{c}")).alias(c))
    return old.join(new, _same("o", "w", keys), "full").select(*columns)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add the rows whose key isn't there, of equal keys the first by order."""
    fresh = first_of(rows, keys, order).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def update_keys(table: DataFrame, keys: DataFrame, on: list[str], values: dict[str, Column], unless: Column | None = None) -> DataFrame:
    """Set columns where the key is listed (and ``unless`` doesn't hold)."""
    marked = table.join(keys.select(*on).distinct().withColumn("__hit", F.lit(True)), on, "left")
    hit = F.col("__hit").isNotNull() if unless is None else F.col("__hit").isNotNull() & ~unless
    return marked.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def update_where(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_anti")


def keep_newest(table: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows by order; a bounded sort, so no task sees the whole table."""
    return table.orderBy(*order).limit(n)


def merge_entities(tables: dict[str, tuple[DataFrame, str]], pairs: DataFrame) -> dict[str, DataFrame]:
    """Re-point the entity column of each table from duplicate to target, pairs (duplicate, target)."""
    out = {}
    for name, (table, column) in tables.items():
        moved = table.join(pairs, table[column] == pairs["duplicate"], "left")
        out[name] = moved.select(*[F.coalesce("target", column).alias(column) if c == column else table[c] for c in table.columns])
    return out

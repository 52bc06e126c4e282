"""Constraint checks as queries: the rows, or keys, that violate.  All follow SQL's three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows in which ``column`` is null."""
    return df.filter(F.col(column).isNull())


def check(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which ``predicate`` is false; where it is null, the row passes."""
    return df.filter(~predicate)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their ``n``; a key with a null is unlike any other."""
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return df.filter(whole).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, or that hold a null, with their ``n``."""
    any_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | any_null)


def foreign_key(child: DataFrame, parent: DataFrame, columns: list[str], references: list[str]) -> DataFrame:
    """Rows of ``child`` whose key no row of ``parent`` has; a key with any null passes."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    keys = parent.select(*[F.col(r).alias(f"_{k}") for k, r in enumerate(references)]).distinct()
    on = reduce(Column.__and__, [F.col(c) == F.col(f"_{k}") for k, c in enumerate(columns)])
    return child.filter(whole).join(keys, on, "left_anti")


def partition_bound(df: DataFrame, key: str, low, high) -> DataFrame:
    """Rows outside of [low, high), or with a null key."""
    inside = (F.col(key) >= low) & (F.col(key) < high)
    return df.filter(~F.coalesce(inside, F.lit(False)))

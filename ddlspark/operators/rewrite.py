"""Rewrites of whole tables, each with the count of rows that would fail before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retyped(df: DataFrame, column: str, type_: str) -> DataFrame:
    """``column`` converted to ``type_``; values that do not convert become null (see ``failures``)."""
    return df.withColumn(column, F.col(column).try_cast(type_))


def failures(df: DataFrame, column: str, type_: str) -> DataFrame:
    """One row: n_rows, and n_failed values that would not convert."""
    lost = F.col(column).isNotNull() & F.col(column).try_cast(type_).isNull()
    return df.agg(F.count("*").alias("n_rows"), F.count_if(lost).alias("n_failed"))


def generated(df: DataFrame, column: str, value: Column) -> DataFrame:
    """A column computed from the others, stored."""
    return df.withColumn(column, value)


def ordered_layout(df: DataFrame, keys: list[str], path: str, partitions: int) -> DataFrame:
    """A copy sorted by ``keys`` over range partitions: files and row groups hold narrow ranges, so scans by key skip most."""
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def relocated(df: DataFrame, path: str) -> DataFrame:
    """A copy at ``path``, returned only if it has the checksum of ``df``."""
    from .copy import checksum

    df.write.parquet(path)
    there = df.sparkSession.read.schema(df.schema).parquet(path)
    if checksum(df, df.columns).first() != checksum(there, df.columns).first():
        raise ValueError(f"the copy at {path} differs")
    return there

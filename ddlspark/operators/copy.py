"""Chunked copies of live tables: chunks, checksums, change application and the gate before a swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """The first 15 hex digits of a row's MD5 as a number.

    Each value follows its length and a null is a mark without one, so rows that differ are different texts, whatever characters they hold.
    """
    text = lambda c: F.col(c).cast("string")
    parts = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("long")


def checksum(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n, bit_xor and sum (modulo 10^9) of row hashes; the sum sees pairs of equal rows, which cancel in the xor."""
    hashed = df.select(*(by or []), row_hash(columns).alias("h"))
    return hashed.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1_000_000_000).alias("s"))


def chunked(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with ``chunk``: ranges of ``size`` numbers of an integer key, which partition all keys; null keys are a chunk of their own, null."""
    return df.withColumn("chunk", F.floor(F.col(key) / size).cast("long"))


def divergent_chunks(source: DataFrame, shadow: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """Chunks whose checksums differ, or that one side lacks."""
    a, b = (checksum(chunked(df, key, size), columns, ["chunk"]) for df in (source, shadow))
    a, b = a.toDF("chunk", "na", "xa", "sa"), b.toDF("other", "nb", "xb", "sb")
    same = F.col("na").eqNullSafe(F.col("nb")) & F.col("xa").eqNullSafe(F.col("xb")) & F.col("sa").eqNullSafe(F.col("sb"))
    both = a.join(b, F.col("chunk").eqNullSafe(F.col("other")), "full")
    return both.filter(~same).select(F.coalesce("chunk", "other").alias("chunk"))


def repaired(source: DataFrame, shadow: DataFrame, key: str, size: int, bad: DataFrame) -> DataFrame:
    """The shadow with its divergent chunks, and only these, copied again."""
    bad = bad.select(F.col("chunk").alias("_bad"))
    at = F.col("chunk").eqNullSafe(F.col("_bad"))
    kept = chunked(shadow, key, size).join(bad, at, "left_anti")
    return kept.unionByName(chunked(source, key, size).join(bad, at, "left_semi")).drop("chunk")


def latest_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """At most one change a key: the last one.  An aggregate with partial sums, so a key with very many changes is no hot spot."""
    rest = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return best.select(key, *[F.col(f"last.{c}").alias(c) for c in rest])


def applied(base: DataFrame, changes: DataFrame, key: str, op: str = "op") -> DataFrame:
    """``base`` after ``changes`` (at most one a key; op is upsert or delete): changes always overwrite."""
    same = [c for c in base.columns]
    kept = base.join(changes.select(key), key, "left_anti").select(*same)
    return kept.unionByName(changes.filter(F.col(op) != "delete").select(*same))


def copied(chunk: DataFrame, shadow: DataFrame, key: str) -> DataFrame:
    """The shadow and the rows of a chunk that it has not: copying never overwrites what a change has written."""
    return shadow.unionByName(chunk.join(shadow.select(key), key, "left_anti").select(*shadow.columns))


def relevant(changes: DataFrame, key: str, copied_up_to: int) -> DataFrame:
    """Changes at or below the copier's position; those above are in rows still to be copied."""
    return changes.filter(F.col(key) <= copied_up_to)


def carried_forward(change: Column, unchanged: Column, old: Column) -> Column:
    """A change's value, or the old one where the change says that it is unchanged; a null value stays a null."""
    return F.when(unchanged, old).otherwise(change)


def chunk_bounds(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """(chunk, low, high, n) of about equal numbers of rows, by approximate quantiles of the key."""
    cuts = df.select(F.percentile_approx(key, [k / chunks for k in range(1, chunks)], 10_000)).first()[0] or []
    placed = df.select(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))).alias("chunk"), F.col(key).alias("k"))
    return placed.groupBy("chunk").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"))


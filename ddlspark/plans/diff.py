"""Convergence of a live table model to a desired one: full outer joins by name, in dependency order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """(table_name, column_name, bucket, change) from two tables of (table_name, column_name, type, nullable).

    Drops come before additions, and these before alterations; columns match by name only, whatever their order.
    """
    a = live.select("table_name", "column_name", F.col("type").alias("old"), F.col("nullable").alias("was"))
    b = desired.select("table_name", "column_name", F.col("type").alias("new"), F.col("nullable").alias("now"))
    both = a.join(b, ["table_name", "column_name"], "full")
    gone, came = F.col("new").isNull(), F.col("old").isNull()
    parts = F.array(
        F.when(gone, F.struct(F.lit(3).alias("bucket"), F.lit("drop column").alias("change"))),
        F.when(came, F.struct(F.lit(4).alias("bucket"), F.lit("add column").alias("change"))),
        F.when(~gone & ~came & (F.col("old") != F.col("new")), F.struct(F.lit(5).alias("bucket"), F.concat(F.lit("alter type "), "old", F.lit(" -> "), "new").alias("change"))),
        F.when(~gone & ~came & F.col("was") & ~F.col("now"), F.struct(F.lit(5).alias("bucket"), F.lit("set not null").alias("change"))),
        F.when(~gone & ~came & ~F.col("was") & F.col("now"), F.struct(F.lit(5).alias("bucket"), F.lit("drop not null").alias("change"))),
    )
    rows = both.select("table_name", "column_name", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("c"))
    return rows.select("table_name", "column_name", "c.bucket", "c.change")


def applied(live: DataFrame, desired: DataFrame, changes: DataFrame) -> DataFrame:
    """The live model after ``changes``; a second diff against ``desired`` must then be empty."""
    dropped = changes.filter("change = 'drop column'").select("table_name", "column_name")
    touched = changes.filter("change <> 'drop column'").select("table_name", "column_name").distinct()
    names = ["table_name", "column_name", "type", "nullable"]
    kept = live.select(*names).join(dropped, names[:2], "left_anti").join(touched, names[:2], "left_anti")
    return kept.unionByName(desired.select(*names).join(touched, names[:2], "left_semi"))


def object_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """(table_name, kind, name, bucket, change, destructive) from two tables of (table_name, kind, name, definition); kind is index or constraint.

    Objects match by name; a changed definition is a drop and an addition.  Indexes are dropped first (1), then constraints (2);
    after the columns' buckets (3 to 5) constraints are added (6), then indexes created (7).
    """
    keys = ["table_name", "kind", "name"]
    a, b = live.select(*keys, F.col("definition").alias("old")), desired.select(*keys, F.col("definition").alias("new"))
    both = a.join(b, keys, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    index = F.col("kind") == "index"
    parts = F.array(
        F.when(F.col("old").isNotNull(), F.struct(F.when(index, 1).otherwise(2).alias("bucket"), F.concat(F.lit("drop "), "kind").alias("change"), F.lit(True).alias("destructive"))),
        F.when(F.col("new").isNotNull(), F.struct(F.when(index, 7).otherwise(6).alias("bucket"), F.concat(F.when(index, "create ").otherwise("add "), "kind").alias("change"), F.lit(False).alias("destructive"))),
    )
    rows = both.select(*keys, F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("c"))
    return rows.select(*keys, "c.bucket", "c.change", "c.destructive")


def default_changes(live: DataFrame, desired: DataFrame) -> DataFrame:
    """(table_name, column_name, bucket, change) of columns on both sides, from (table_name, column_name, default_value; null for none)."""
    keys = ["table_name", "column_name"]
    both = live.select(*keys, F.col("default_value").alias("old")).join(desired.select(*keys, F.col("default_value").alias("new")), keys)
    change = F.when(F.col("new").isNull(), "drop default").otherwise(F.concat(F.lit("set default "), "new"))
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, F.lit(5).alias("bucket"), change.alias("change"))


def refusals(live: DataFrame, desired: DataFrame) -> DataFrame:
    """(table_name, refusal) for differences of tables that no change of columns or objects can settle.

    Both sides have one row a table: (table_name, partition_key, is_partition, unlogged).  Tables that are on one side only are not compared.
    """
    names = ["partition_key", "is_partition", "unlogged"]
    both = live.select("table_name", *[F.col(c).alias(f"old_{c}") for c in names]).join(desired.select("table_name", *names), "table_name")
    texts = {"partition_key": "partition-key-differs", "is_partition": "partition-attachment-differs", "unlogged": "persistence-differs"}
    found = F.array(*[F.when(~F.col(f"old_{c}").eqNullSafe(F.col(c)), text) for c, text in texts.items()])
    return both.select("table_name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("refusal"))


def refused_columns(live: DataFrame, desired: DataFrame) -> DataFrame:
    """(table_name, column_name, refusal) of columns to add that an added column's text cannot carry.

    Both sides have (table_name, column_name); ``desired`` also sequence_default (boolean) and collation (null or empty for none).
    """
    keys = ["table_name", "column_name"]
    came = desired.join(live.select(*keys), keys, "left_anti")
    why = F.when(F.col("sequence_default"), "sequence-default").when(F.length("collation") > 0, "collation")
    return came.select(*keys, why.alias("refusal")).filter("refusal is not null")

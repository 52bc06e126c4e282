"""Readers of the tables, and catalog tables (columns, constraints) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """(table_name, column_name, position, type): one row a column of each table, from the files' own schemas."""
    rows = [(t, f.name, k, f.dataType.simpleString()) for t in names for k, f in enumerate(table(spark, sf_dir, t).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, type string")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of schema-change operations: each row of ``part`` is a statement of one to three operations.

    Every fact that the classifier asks for is drawn from the part's numbers, so any number of statements can be had.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stmt_id"), F.col("p_size").alias("size"))
    seq = part.withColumn("op_no", F.explode(F.sequence(F.lit(0), (F.col("stmt_id") % 3).cast("int"))))
    draw = F.col("stmt_id") * 7 + F.col("op_no") * 13 + F.col("size")
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))
    return seq.select(
        "stmt_id",
        "op_no",
        pick(KINDS, draw).alias("kind"),
        pick(("none", "constant", "expression"), F.floor(draw / 3)).alias("default_kind"),
        (F.floor(draw / 5) % 4 == 0).alias("generated"),
        pick(("none", "none", "known", "unknown"), F.floor(draw / 7)).alias("inline"),
        F.when(F.floor(draw / 17) % 6 != 0, pick(TYPES, F.floor(draw / 2))).alias("old_type"),
        pick(TYPES, F.floor(draw / 11)).alias("new_type"),
        (F.floor(draw / 13) % 5 == 0).alias("has_using"),
        (F.floor(draw / 3) % 2 == 0).alias("named"),
        (F.floor(draw / 4) % 3 == 0).alias("not_valid"),
        (F.floor(draw / 9) % 6 == 0).alias("using_index"),
        (F.floor(draw / 6) % 3 == 0).alias("concurrently"),
        pick(("primary key", "unique", "check", "foreign key", "not null", "exclude"), F.floor(draw / 2)).alias("constraint_kind"),
    )


#: The operation kinds and the column types that the classifier tells apart.
KINDS = (
    "create table", "create partition", "add column", "drop column", "alter type", "set default", "drop default", "set not null", "drop not null",
    "set statistics", "rename column", "rename table", "rename index", "set schema", "set tablespace", "set storage", "add constraint",
    "validate constraint", "drop constraint", "attach partition", "detach partition", "create index", "drop index", "reindex", "unrecognized",
)
TYPES = ("varchar(20)", "varchar(50)", "varchar", "text", "numeric(10,2)", "numeric(12,2)", "decimal(12,4)", "integer", "varchar(50)[]")

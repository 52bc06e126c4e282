"""What each schema-change operation costs a live table: route, reason, disposition and lint, as Column expressions.

Operations are rows (see ``sources.tables.operations``), so a corpus of any number of statements is classified in one
pass; only the verdict of whole statements needs an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import binary_coercible

# Operation kinds by what they do.
METADATA = ("create table", "drop column", "set default", "drop default", "drop not null", "set statistics", "rename index", "set schema", "set storage", "drop constraint")
DESTRUCTIVE = ("drop column", "drop constraint", "drop index")
NOT_EXECUTED = ("create table", "create partition", "rename index", "drop index", "reindex", "unrecognized")
INDEXES = ("create index", "drop index", "reindex", "detach partition")


def reason() -> Column:
    """The reason code; order matters, most of all for ADD COLUMN."""
    kind, constraint = F.col("kind"), F.col("constraint_kind")
    add = (
        F.when(F.col("inline") == "unknown", "unsupported-operation")
        .when(F.col("generated"), "generated-stored")
        .when(F.col("default_kind") == "expression", "volatile-default")
        .when(F.col("inline") == "known", "safer-idiom")
        .when(F.col("default_kind") == "constant", "fast-default")
        .otherwise("metadata-only")
    )
    retype = F.when(~F.col("has_using") & binary_coercible(F.col("old_type"), F.col("new_type")), "binary-coercible").otherwise("type-rewrite")
    constrain = F.when(F.col("using_index") | F.col("not_valid"), "online-idiom").when(constraint == "exclude", "unsupported-operation").otherwise("safer-idiom")
    return (
        F.when(kind == "create partition", "partition-parent-lock")
        .when(kind == "add column", add)
        .when(kind == "alter type", retype)
        .when(kind == "set not null", "safer-idiom")
        .when(kind.isin("rename column", "rename table"), "app-breaking-rename")
        .when(kind == "set tablespace", "relocation")
        .when(kind == "add constraint", constrain)
        .when(kind == "validate constraint", "online-idiom")
        .when(kind == "attach partition", "safer-idiom")
        .when(kind.isin(*INDEXES), F.when(F.col("concurrently"), "online-idiom").otherwise("safer-idiom"))
        .when(kind.isin(*METADATA), "metadata-only")
        .otherwise("unsupported-operation")
    )


def unverified() -> Column:
    """Whether a rewrite is only assumed: the column's live type is not known, and a fact could prove a relabel."""
    return (F.col("kind") == "alter type") & ~F.col("has_using") & F.col("old_type").isNull()


def route(reason_: Column) -> Column:
    return F.when(reason_ == "unsupported-operation", "refuse").when(reason_.isin("generated-stored", "volatile-default", "type-rewrite", "relocation"), "copy-and-swap").otherwise("native")


def has_steps() -> Column:
    """Whether a safer-idiom operation has a built sequence of steps; it must be its statement's only one."""
    kind, constraint = F.col("kind"), F.col("constraint_kind")
    built = (kind == "set not null") | kind.isin(*INDEXES) | ((kind == "add constraint") & (constraint.isin("primary key", "unique") | (constraint.isin("check", "foreign key") & F.col("named"))))
    return (F.col("reason") == "safer-idiom") & built


def classified(operations: DataFrame) -> DataFrame:
    """``operations`` with reason, route, rank (of the route, worst highest), unverified, destructive and steps."""
    return (
        operations.withColumn("reason", reason())
        .withColumn("route", route(F.col("reason")))
        .withColumn("rank", F.when(F.col("route") == "refuse", 2).when(F.col("route") == "copy-and-swap", 1).otherwise(0))
        .withColumn("unverified", unverified())
        .withColumn("destructive", F.col("kind").isin(*DESTRUCTIVE))
        .withColumn("steps", has_steps())
    )


def statements(decisions: DataFrame) -> DataFrame:
    """One row a statement: its worst route, disposition, and how many operations it has, of those destructive."""
    whole = decisions.groupBy("stmt_id").agg(
        F.max("rank").alias("rank"),
        F.count("*").alias("n_ops"),
        F.count_if("destructive").alias("n_destructive"),
        F.count_if((F.col("reason") == "safer-idiom") & ~F.col("steps")).alias("unbuilt"),
        F.count_if(F.col("reason") == "safer-idiom").alias("safer"),
    )
    worst = F.when(F.col("rank") == 2, "refuse").when(F.col("rank") == 1, "copy-and-swap").otherwise("native")
    stuck = (F.col("unbuilt") > 0) | ((F.col("safer") > 0) & (F.col("n_ops") > 1))
    disposition = F.when(F.col("rank") == 2, "refuse").when(F.col("rank") == 1, "unavailable").when(stuck, "rewrite-required").otherwise("execute")
    return whole.select("stmt_id", worst.alias("route"), disposition.alias("disposition"), "n_ops", "n_destructive")


def findings(decisions: DataFrame) -> DataFrame:
    """Lint findings: (stmt_id, op_no, code, severity); an operation may have a routing and a destructive one."""
    r = F.col("reason")
    code = (
        F.when(r == "unsupported-operation", "unsupported-operation")
        .when(F.col("unverified"), "possible-table-rewrite")
        .when(F.col("route") == "copy-and-swap", "table-rewrite")
        .when(r == "safer-idiom", "blocking-idiom")
        .when(r == "app-breaking-rename", "app-breaking-rename")
    )
    severity = F.when(F.col("code") == "unsupported-operation", "error").otherwise("warning")
    both = decisions.select("stmt_id", "op_no", F.explode(F.array(code, F.when(F.col("destructive"), "destructive"))).alias("code")).filter("code is not null")
    return both.withColumn("severity", severity)


def fingerprints(plans: DataFrame) -> DataFrame:
    """(plan_id, fingerprint) of ``plans`` (plan_id, pos, sql, route, backend, disposition, exec_sql): a digest of what would execute, in order.

    Each field ends with 0x1F and each statement with 0x1E.  Reasons are left out: they explain, but change nothing.
    """
    end = F.lit("\x1f")
    fields = F.concat(F.array("sql", "route", "backend", "disposition"), "exec_sql")
    one = F.concat(F.array_join(F.transform(fields, lambda x: F.concat(F.coalesce(x, F.lit("")), end)), ""), F.lit("\x1e"))
    whole = plans.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("pos", one.alias("text")))).alias("parts"))
    return whole.select("plan_id", F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.col("parts.text"), ""), 256)).alias("fingerprint"))


def required_tier(decisions: DataFrame) -> DataFrame:
    """1 for a statement that alters a table, 2 if it also builds an index, null if it is of a kind that is never executed."""
    kind = F.col("kind")
    builds = (kind == "create index") | ((kind == "add constraint") & F.col("constraint_kind").isin("primary key", "unique", "exclude") & ~F.col("using_index"))
    known = ~kind.isin(*NOT_EXECUTED)
    return decisions.groupBy("stmt_id").agg(F.when(F.bool_and(known), F.max(F.when(builds, 2).otherwise(1))).alias("tier"))

"""Advice on classified operations: caveats of built sequences, manual guidance, what the front door refuses, and partitioned parents.

All are Column expressions over the rows of ``plans.classify``, so any number of operations is advised on in one pass.
Nulls: a fact that is null counts as false; an operation without a caveat or guidance has an empty array or a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Caveats of a sequence by what it does.
INDEX_CAVEATS = ("non-transactional", "invalid-index-on-failure")
DETACH_CAVEATS = ("non-transactional", "detach-finalize-on-failure")
UNIQUE_CAVEATS = ("non-transactional", "separate-transactions", "invalid-index-on-failure")
SCAFFOLD_CAVEATS = ("separate-transactions", "validation-scan", "scaffold-constraint-on-failure")


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def caveats() -> Column:
    """Of a statement's only operation, if it has a built sequence: what its user has to know; else an empty array.  Needs ``n_ops``."""
    kind, constraint = F.col("kind"), F.col("constraint_kind")
    constrains = kind == "add constraint"
    found = (
        F.when(kind == "detach partition", _texts(DETACH_CAVEATS))
        .when(kind.isin("create index", "drop index", "reindex"), _texts(INDEX_CAVEATS))
        .when(constrains & constraint.isin("primary key", "unique"), _texts(UNIQUE_CAVEATS))
        .when((kind == "set not null") | (constrains & constraint.isin("check", "foreign key")), _texts(SCAFFOLD_CAVEATS))
    )
    return F.coalesce(F.when(F.col("steps") & (F.col("n_ops") == 1), found), F.array().cast("array<string>"))


def guidance() -> Column:
    """What to do by hand with a safer-idiom operation for which no sequence can be run; null for all others.  Needs ``n_ops`` of its statement."""
    kind, constraint = F.col("kind"), F.col("constraint_kind")
    alone = (
        F.when(kind == "add column", "add-column-then-constraint")
        .when(kind == "attach partition", "prevalidated-check")
        .when(constraint == "not null", "not-null-scaffold")
        .when(constraint.isin("check", "foreign key"), "name-constraint-then-validate")
        .when(constraint.isin("primary key", "unique"), "unique-index-then-constraint")
    )
    return F.when(F.col("reason") == "safer-idiom", F.when(F.col("n_ops") > 1, "split-statement").when(~F.col("steps"), alone))


def refused() -> Column:
    """Why the door for changes of existing tables refuses an operation's statement, before any table is looked at; null where it goes on."""
    kind = F.col("kind")
    return F.when(kind.isin("drop index", "reindex"), "index-statement").when(kind.isin("create table", "create partition", "rename index", "unrecognized"), "unsupported-statement")


def parent_cause(server_major: int) -> Column:
    """Why an operation, run as written, cannot run on a partitioned parent; null where it can."""
    kind, constraint = F.col("kind"), F.col("constraint_kind")
    constrains = kind == "add constraint"
    builds = (kind == "create index") | (constrains & constraint.isin("primary key", "unique", "exclude"))
    foreign = constrains & (constraint == "foreign key") & F.col("not_valid") & F.lit(server_major < 18)
    return (
        F.when(constrains & F.col("using_index"), "index-adoption")
        .when(foreign, "not-valid-foreign-key")
        .when(builds, F.when((kind == "create index") & F.col("concurrently"), "concurrent-index-build").otherwise("blocking-index-build"))
    )


def advised(decisions: DataFrame, server_major: int = 17) -> DataFrame:
    """``decisions`` with caveats, guidance, refused and parent_cause."""
    sizes = decisions.groupBy("stmt_id").agg(F.count("*").alias("n_ops"))
    out = decisions.join(sizes, "stmt_id")
    return out.withColumn("caveats", caveats()).withColumn("guidance", guidance()).withColumn("refused", refused()).withColumn("parent_cause", parent_cause(server_major)).drop("n_ops")


def tree_sizes(relations: DataFrame, limit_bytes: int) -> DataFrame:
    """(name, total_bytes, blocked) of ``relations`` (name, parent, relation_bytes): each with all that hangs below it; blocked above ``limit_bytes``.

    Each round doubles the length of the known paths, so a tree of depth d takes about log2(d) rounds; partition trees are shallow, so the
    plan stays small.  A null size counts as 0; a parent that is not there adds nothing; parents must not form a circle.
    """
    nodes = relations.select("name", "parent", F.coalesce("relation_bytes", F.lit(0)).cast("long").alias("relation_bytes"))
    named = nodes.select(F.col("name").alias("parent"))
    links = nodes.join(named, "parent", "left_semi").select(F.col("name").alias("below"), F.col("parent").alias("above"), F.lit(1).alias("steps"))
    length = 1
    while not links.filter(F.col("steps") == length).isEmpty():
        # a path of the whole length so far, and any path on top of it
        lower = links.filter(F.col("steps") == length).select("below", F.col("above").alias("middle"))
        upper = links.select(F.col("below").alias("middle"), "above", F.col("steps").alias("more"))
        links = links.unionByName(lower.join(upper, "middle").select("below", "above", (F.col("more") + length).alias("steps")))
        length *= 2
    parts = links.select(F.col("above").alias("name"), F.col("below").alias("part")).join(nodes.select(F.col("name").alias("part"), "relation_bytes"), "part")
    below = parts.groupBy("name").agg(F.sum("relation_bytes").alias("lower"))
    total = F.col("relation_bytes") + F.coalesce("lower", F.lit(0))
    return nodes.join(below, "name", "left").select("name", total.alias("total_bytes"), (total > limit_bytes).alias("blocked"))

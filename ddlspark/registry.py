"""All queries of the engine itself, with the DuckDB SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import binary_coercible, fitted
from .operators import copy, rewrite, validate
from .plans import advice, classify, diff
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its name, with its DuckDB SQL."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        _oracles[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# --- constraints against rows

@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '1-URGENT') IS NULL")
def validate_not_null(spark, d):
    orders = tables.table(spark, d, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return validate.not_null(orders, "p").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (nullif(l_discount, 0.05) < 0.1)")
def validate_check(spark, d):
    rows = validate.check(tables.table(spark, d, "lineitem"), F.nullif("l_discount", F.lit(0.05)) < 0.1)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def validate_unique(spark, d):
    return validate.unique(tables.table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def validate_pk(spark, d):
    return validate.primary_key(tables.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1 OR o_orderkey IS NULL")
def validate_pk_passes(spark, d):
    return validate.primary_key(tables.table(spark, d, "orders"), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey <> 3)")
def validate_fk(spark, d):
    parent = tables.table(spark, d, "customer").filter("c_nationkey <> 3")
    return validate.foreign_key(tables.table(spark, d, "orders"), parent, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderkey >= 0 AND o_orderkey < (SELECT max(o_orderkey) FROM orders), false)")
def partition_bound_check(spark, d):
    orders = tables.table(spark, d, "orders")
    high = orders.agg(F.max("o_orderkey")).first()[0]
    return validate.partition_bound(orders, "o_orderkey", 0, high).select("o_orderkey")


# --- rewrites

@query("SELECT event_id, try_cast(substr(props, 7, 2) AS INTEGER) AS k FROM events")
def type_rewrite(spark, d):
    events = tables.table(spark, d, "events").select("event_id", F.substring("props", 7, 2).alias("k"))
    return rewrite.retyped(events, "k", "int")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE x IS NOT NULL AND NOT regexp_matches(x, '^[0-9]+$')) AS n_failed FROM (SELECT substr(props, 7, 2) AS x FROM events)")
def failable_cast_count(spark, d):
    return rewrite.failures(tables.table(spark, d, "events").select(F.substring("props", 7, 2).alias("x")), "x", "int")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_quantity) AS BIGINT) * 2 AS doubled FROM lineitem")
def generated_column(spark, d):
    rows = rewrite.generated(tables.table(spark, d, "lineitem"), "doubled", F.round("l_quantity").cast("long") * 2)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "doubled")


# --- classification of operations

_OPS = """
WITH part_ops AS (SELECT p_partkey AS stmt_id, unnest(range(0, p_partkey % 3 + 1)) AS op_no, p_size FROM part),
drawn AS (SELECT *, stmt_id * 7 + op_no * 13 + p_size AS z FROM part_ops),
ops AS (SELECT stmt_id, CAST(op_no AS INTEGER) AS op_no,
  ['create table','create partition','add column','drop column','alter type','set default','drop default','set not null','drop not null','set statistics','rename column','rename table','rename index','set schema','set tablespace','set storage','add constraint','validate constraint','drop constraint','attach partition','detach partition','create index','drop index','reindex','unrecognized'][z % 25 + 1] AS kind,
  ['none','constant','expression'][z // 3 % 3 + 1] AS default_kind, z // 5 % 4 = 0 AS generated,
  ['none','none','known','unknown'][z // 7 % 4 + 1] AS inl,
  CASE WHEN z // 17 % 6 <> 0 THEN ['varchar(20)','varchar(50)','varchar','text','numeric(10,2)','numeric(12,2)','decimal(12,4)','integer','varchar(50)[]'][z // 2 % 9 + 1] END AS old_type,
  ['varchar(20)','varchar(50)','varchar','text','numeric(10,2)','numeric(12,2)','decimal(12,4)','integer','varchar(50)[]'][z // 11 % 9 + 1] AS new_type,
  z // 13 % 5 = 0 AS has_using, z // 3 % 2 = 0 AS named, z // 4 % 3 = 0 AS not_valid, z // 9 % 6 = 0 AS using_index, z // 6 % 3 = 0 AS conc,
  ['primary key','unique','check','foreign key','not null','exclude'][z // 2 % 6 + 1] AS con FROM drawn),
fits(o, n) AS (VALUES ('varchar(20)','varchar(50)'),('varchar(20)','varchar'),('varchar(20)','text'),('varchar(50)','varchar'),('varchar(50)','text'),('varchar','text'),('numeric(10,2)','numeric(12,2)')),
reasoned AS (SELECT ops.*, CASE kind
  WHEN 'create partition' THEN 'partition-parent-lock' WHEN 'set tablespace' THEN 'relocation' WHEN 'unrecognized' THEN 'unsupported-operation'
  WHEN 'rename column' THEN 'app-breaking-rename' WHEN 'rename table' THEN 'app-breaking-rename'
  WHEN 'validate constraint' THEN 'online-idiom' WHEN 'set not null' THEN 'safer-idiom' WHEN 'attach partition' THEN 'safer-idiom'
  WHEN 'alter type' THEN CASE WHEN NOT has_using AND ((old_type = new_type AND new_type NOT LIKE '%]') OR EXISTS (SELECT 1 FROM fits WHERE o = old_type AND n = new_type)) THEN 'binary-coercible' ELSE 'type-rewrite' END
  WHEN 'add column' THEN CASE WHEN inl = 'unknown' THEN 'unsupported-operation' WHEN generated THEN 'generated-stored' WHEN default_kind = 'expression' THEN 'volatile-default' WHEN inl = 'known' THEN 'safer-idiom' WHEN default_kind = 'constant' THEN 'fast-default' ELSE 'metadata-only' END
  WHEN 'add constraint' THEN CASE WHEN using_index OR not_valid THEN 'online-idiom' WHEN con = 'exclude' THEN 'unsupported-operation' ELSE 'safer-idiom' END
  ELSE CASE WHEN kind IN ('detach partition','create index','drop index','reindex') THEN CASE WHEN conc THEN 'online-idiom' ELSE 'safer-idiom' END ELSE 'metadata-only' END END AS reason FROM ops),
decided AS (SELECT *, CASE WHEN reason = 'unsupported-operation' THEN 2 WHEN reason IN ('generated-stored','volatile-default','type-rewrite','relocation') THEN 1 ELSE 0 END AS rank,
  kind IN ('drop column','drop constraint','drop index') AS destructive, kind = 'alter type' AND NOT has_using AND old_type IS NULL AS unverified,
  reason = 'safer-idiom' AND (kind IN ('set not null','detach partition','create index','drop index','reindex') OR (kind = 'add constraint' AND (con IN ('primary key','unique') OR (con IN ('check','foreign key') AND named)))) AS steps FROM reasoned),
routed AS (SELECT *, ['native','copy-and-swap','refuse'][rank + 1] AS route FROM decided)
"""  # noqa: E501


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return classify.classified(tables.operations(spark, d))


@query(_OPS + "SELECT stmt_id, op_no, kind, route, reason, unverified, destructive, steps FROM routed")
def classify_corpus(spark, d):
    return _decisions(spark, d).select("stmt_id", "op_no", "kind", "route", "reason", "unverified", "destructive", "steps")


@query(_OPS + "SELECT stmt_id, ['native','copy-and-swap','refuse'][max(rank) + 1] AS route FROM routed GROUP BY stmt_id")
def worst_route(spark, d):
    return classify.statements(_decisions(spark, d)).select("stmt_id", "route")


@query(
    _OPS
    + """SELECT stmt_id, count(*) AS n_ops, count(*) FILTER (WHERE destructive) AS n_destructive,
  CASE max(rank) WHEN 2 THEN 'refuse' WHEN 1 THEN 'unavailable' ELSE CASE WHEN bool_or(reason = 'safer-idiom' AND NOT steps) OR (bool_or(reason = 'safer-idiom') AND count(*) > 1) THEN 'rewrite-required' ELSE 'execute' END END AS disposition
  FROM routed GROUP BY stmt_id"""
)
def route_disposition(spark, d):
    return classify.statements(_decisions(spark, d)).select("stmt_id", "n_ops", "n_destructive", "disposition")


_LINT = (
    _OPS
    + """, codes AS (SELECT stmt_id, op_no, CASE WHEN rank = 2 THEN 'unsupported-operation' WHEN unverified THEN 'possible-table-rewrite' WHEN rank = 1 THEN 'table-rewrite' WHEN reason = 'safer-idiom' THEN 'blocking-idiom' WHEN reason = 'app-breaking-rename' THEN reason END AS code FROM routed
  UNION ALL SELECT stmt_id, op_no, 'destructive' FROM routed WHERE destructive),
found AS (SELECT *, CASE WHEN code = 'unsupported-operation' THEN 'error' ELSE 'warning' END AS severity FROM codes WHERE code IS NOT NULL) """
)


@query(_LINT + "SELECT stmt_id, op_no, code, severity FROM found")
def lint_findings(spark, d):
    return classify.findings(_decisions(spark, d))


@query(_LINT + "SELECT code, severity, count(*) AS n, count(DISTINCT stmt_id) AS n_statements FROM found GROUP BY ALL")
def lint_counts(spark, d):
    return classify.findings(_decisions(spark, d)).groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_distinct("stmt_id").alias("n_statements"))


_PLANS = (
    _OPS
    + """, plans AS (SELECT stmt_id // 7 AS plan_id, stmt_id AS pos, 'alter t' || stmt_id || ': ' || string_agg(kind, ', ' ORDER BY op_no) AS sql, ['native','copy-and-swap','refuse'][max(rank) + 1] AS route,
  ['direct','shadow','none'][max(rank) + 1] AS backend, ['execute','unavailable','refuse'][max(rank) + 1] AS disposition, list(kind ORDER BY op_no) FILTER (rank = 0) AS steps FROM routed GROUP BY stmt_id),
texts AS (SELECT plan_id, pos, sql || chr(31) || route || chr(31) || backend || chr(31) || disposition || chr(31) || coalesce(array_to_string(list_transform(steps, lambda x: x || chr(31)), ''), '') || chr(30) AS t FROM plans) """
)


@query(_PLANS + "SELECT plan_id, 'sha256:' || sha256(string_agg(t, '' ORDER BY pos)) AS fingerprint FROM texts GROUP BY plan_id")
def plan_fingerprint(spark, d):
    ops = _decisions(spark, d).groupBy("stmt_id").agg(F.max("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("op_no", "kind", F.col("rank").alias("r")))).alias("ops"))
    named = lambda names: F.get(F.array(*map(F.lit, names)), F.col("rank"))
    steps = F.transform(F.filter("ops", lambda x: x.r == 0), lambda x: x.kind)
    sql = F.concat(F.lit("alter t"), "stmt_id", F.lit(": "), F.array_join(F.col("ops.kind"), ", "))
    return classify.fingerprints(ops.select(F.floor(F.col("stmt_id") / 7).alias("plan_id"), F.col("stmt_id").alias("pos"), sql.alias("sql"), named(("native", "copy-and-swap", "refuse")).alias("route"), named(("direct", "shadow", "none")).alias("backend"), named(("execute", "unavailable", "refuse")).alias("disposition"), steps.alias("exec_sql")))


@query(_OPS + "SELECT stmt_id, CASE WHEN NOT bool_or(kind IN ('create table','create partition','rename index','drop index','reindex','unrecognized')) THEN CAST(max(CASE WHEN kind = 'create index' OR (kind = 'add constraint' AND con IN ('primary key','unique','exclude') AND NOT using_index) THEN 2 ELSE 1 END) AS INTEGER) END AS tier FROM routed GROUP BY stmt_id")
def required_tier(spark, d):
    return classify.required_tier(_decisions(spark, d))


@query(_OPS + "SELECT DISTINCT old_type, new_type, coalesce(old_type = new_type AND new_type NOT LIKE '%]', false) OR EXISTS (SELECT 1 FROM fits WHERE o = old_type AND n = new_type) AS coercible FROM ops")
def binary_coercible_matrix(spark, d):
    ops = tables.operations(spark, d).select("old_type", "new_type").distinct()
    return ops.withColumn("coercible", binary_coercible(F.col("old_type"), F.col("new_type")))


@query("SELECT p_partkey, CASE WHEN strlen(x) <= 63 THEN x ELSE left(x, list_max(list_filter(range(0, 55), lambda k: strlen(left(x, k)) <= 54))) || '_' || substr(sha256(x), 1, 8) END AS name FROM (SELECT p_partkey, repeat(replace(p_name, 'a', 'é') || '_€', CAST(p_partkey % 5 + 1 AS INTEGER)) || 'idx' AS x FROM part)")
def fitted_identifiers(spark, d):
    name = F.concat(F.repeat(F.concat(F.replace("p_name", F.lit("a"), F.lit("é")), F.lit("_€")), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("idx"))
    return tables.table(spark, d, "part").select("p_partkey", fitted(name).alias("name"))


@query(
    _OPS
    + """, sized AS (SELECT *, count(*) OVER (PARTITION BY stmt_id) AS n_ops FROM routed)
SELECT stmt_id, op_no,
  CASE WHEN NOT steps OR n_ops > 1 THEN '' WHEN kind = 'detach partition' THEN 'non-transactional,detach-finalize-on-failure' WHEN kind LIKE '%index' THEN 'non-transactional,invalid-index-on-failure'
    WHEN con IN ('primary key','unique') AND kind <> 'set not null' THEN 'non-transactional,separate-transactions,invalid-index-on-failure' ELSE 'separate-transactions,validation-scan,scaffold-constraint-on-failure' END AS caveats,
  CASE WHEN reason <> 'safer-idiom' THEN NULL WHEN n_ops > 1 THEN 'split-statement' WHEN steps THEN NULL WHEN kind = 'add column' THEN 'add-column-then-constraint' WHEN kind = 'attach partition' THEN 'prevalidated-check'
    WHEN con = 'not null' THEN 'not-null-scaffold' WHEN con IN ('check','foreign key') THEN 'name-constraint-then-validate' ELSE 'unique-index-then-constraint' END AS guidance,
  CASE WHEN kind IN ('drop index','reindex') THEN 'index-statement' WHEN kind IN ('create table','create partition','rename index','unrecognized') THEN 'unsupported-statement' END AS refused,
  CASE kind WHEN 'create index' THEN CASE WHEN conc THEN 'concurrent-index-build' ELSE 'blocking-index-build' END
    WHEN 'add constraint' THEN CASE WHEN using_index THEN 'index-adoption' WHEN con = 'foreign key' AND not_valid THEN 'not-valid-foreign-key' WHEN con IN ('primary key','unique','exclude') THEN 'blocking-index-build' END END AS parent_cause
  FROM sized"""
)
def operation_advice(spark, d):
    out = advice.advised(_decisions(spark, d))
    return out.select("stmt_id", "op_no", F.array_join("caveats", ",").alias("caveats"), "guidance", "refused", "parent_cause")


@query(
    """WITH RECURSIVE up(name, above) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT name, above // 4 FROM up WHERE above >= 4)
SELECT a.p_partkey AS name, CAST(sum(p.p_size) * 1000 AS BIGINT) AS total_bytes, sum(p.p_size) * 1000 > 100000 AS blocked FROM up JOIN part p ON p.p_partkey = name JOIN part a ON a.p_partkey = above GROUP BY a.p_partkey"""
)
def partition_tree_sizes(spark, d):
    """The parts as a tree: each hangs below the one of a quarter of its number."""
    parent = F.when(F.col("p_partkey") >= 4, F.floor(F.col("p_partkey") / 4).cast("long"))
    relations = tables.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("name"), parent.alias("parent"), (F.col("p_size") * 1000).alias("relation_bytes"))
    return advice.tree_sizes(relations, 100_000)


# --- declarative diff: the live model is made of the parts, the desired one of them shifted

_MODELS = """
WITH live AS (SELECT 't' || p_partkey % 20 AS table_name, 'c' || p_partkey // 20 AS column_name, ['int','bigint','text'][p_size % 3 + 1] AS type, p_size % 2 = 0 AS nullable FROM part WHERE p_partkey % 7 <> 0),
desired AS (SELECT 't' || p_partkey % 20 AS table_name, 'c' || p_partkey // 20 AS column_name, ['int','bigint','text'][(p_size + p_partkey % 2) % 3 + 1] AS type, p_size % 4 = 0 AS nullable FROM part WHERE p_partkey % 11 <> 0),
sides AS (SELECT table_name, column_name, l.type AS old, d.type AS new, l.nullable AS was, d.nullable AS now FROM live l FULL JOIN desired d USING (table_name, column_name))
"""  # noqa: E501


def _models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = tables.table(spark, d, "part")
    name = [F.concat(F.lit("t"), F.col("p_partkey") % 20).alias("table_name"), F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 20)).alias("column_name")]
    type_ = lambda k: F.element_at(F.array(F.lit("int"), F.lit("bigint"), F.lit("text")), (k % 3 + 1).cast("int")).alias("type")
    live = part.filter("p_partkey % 7 <> 0").select(*name, type_(F.col("p_size")), (F.col("p_size") % 2 == 0).alias("nullable"))
    desired = part.filter("p_partkey % 11 <> 0").select(*name, type_(F.col("p_size") + F.col("p_partkey") % 2), (F.col("p_size") % 4 == 0).alias("nullable"))
    return live, desired


@query(
    _MODELS
    + """SELECT table_name, column_name, 3 AS bucket, 'drop column' AS change FROM sides WHERE new IS NULL
  UNION ALL SELECT table_name, column_name, 4, 'add column' FROM sides WHERE old IS NULL
  UNION ALL SELECT table_name, column_name, 5, 'alter type ' || old || ' -> ' || new FROM sides WHERE old <> new
  UNION ALL SELECT table_name, column_name, 5, 'set not null' FROM sides WHERE was AND NOT now
  UNION ALL SELECT table_name, column_name, 5, 'drop not null' FROM sides WHERE NOT was AND now"""
)
def diff_columns(spark, d):
    return diff.column_changes(*_models(spark, d))


@query("SELECT '' AS table_name, '' AS column_name, 0 AS bucket, '' AS change WHERE false")
def diff_converges(spark, d):
    live, desired = _models(spark, d)
    return diff.column_changes(diff.applied(live, desired, diff.column_changes(live, desired)), desired)


_OBJECTS = """
WITH live AS (SELECT 't' || p_partkey % 20 AS table_name, CASE WHEN p_partkey % 3 = 0 THEN 'index' ELSE 'constraint' END AS kind, 'o' || p_partkey // 20 AS name, 'on (c' || p_size % 4 || ')' AS definition FROM part WHERE p_partkey % 7 <> 0),
desired AS (SELECT 't' || p_partkey % 20 AS table_name, CASE WHEN p_partkey % 3 = 0 THEN 'index' ELSE 'constraint' END AS kind, 'o' || p_partkey // 20 AS name, 'on (c' || (p_size + CAST(p_partkey % 5 = 0 AS INTEGER)) % 4 || ')' AS definition FROM part WHERE p_partkey % 11 <> 0)
"""  # noqa: E501


@query(
    _OBJECTS
    + """SELECT table_name, kind, name, CASE kind WHEN 'index' THEN 1 ELSE 2 END AS bucket, 'drop ' || kind AS change, true AS destructive FROM (SELECT * FROM live EXCEPT SELECT * FROM desired)
  UNION ALL SELECT table_name, kind, name, CASE kind WHEN 'index' THEN 7 ELSE 6 END, CASE kind WHEN 'index' THEN 'create index' ELSE 'add constraint' END, false FROM (SELECT * FROM desired EXCEPT SELECT * FROM live)"""
)
def diff_objects(spark, d):
    part = tables.table(spark, d, "part")
    table_name, name = F.concat(F.lit("t"), F.col("p_partkey") % 20), F.concat(F.lit("o"), F.floor(F.col("p_partkey") / 20))
    kind = F.when(F.col("p_partkey") % 3 == 0, "index").otherwise("constraint")
    on = lambda k: F.concat(F.lit("on (c"), k % 4, F.lit(")"))
    names = [table_name.alias("table_name"), kind.alias("kind"), name.alias("name")]
    live = part.filter("p_partkey % 7 <> 0").select(*names, on(F.col("p_size")).alias("definition"))
    desired = part.filter("p_partkey % 11 <> 0").select(*names, on(F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).alias("definition"))
    return diff.object_changes(live, desired)


@query("SELECT 't' || p_partkey % 20 AS table_name, 'c' || p_partkey // 20 AS column_name, 5 AS bucket, CASE WHEN p_size % 3 = 0 THEN 'drop default' ELSE 'set default ' || p_size % 3 END AS change FROM part WHERE nullif(p_size % 2, 0) IS DISTINCT FROM nullif(p_size % 3, 0)")
def diff_defaults(spark, d):
    part = tables.table(spark, d, "part")
    names = [F.concat(F.lit("t"), F.col("p_partkey") % 20).alias("table_name"), F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 20)).alias("column_name")]
    default = lambda k: F.nullif(F.col("p_size") % k, F.lit(0)).cast("string").alias("default_value")
    return diff.default_changes(part.select(*names, default(2)), part.select(*names, default(3)))


@query(
    """SELECT p_partkey AS table_name, unnest(list_filter([CASE WHEN nullif(p_size % 3, 0) IS DISTINCT FROM nullif(p_size % 4, 0) THEN 'partition-key-differs' END,
  CASE WHEN (p_size % 5 = 0) <> (p_partkey % 5 = 0) THEN 'partition-attachment-differs' END, CASE WHEN (p_size % 7 = 0) <> (p_partkey % 7 = 0) THEN 'persistence-differs' END], lambda x: x IS NOT NULL)) AS refusal FROM part"""
)
def diff_refusals(spark, d):
    def side(key, number):
        facts = [F.nullif(F.col("p_size") % key, F.lit(0)).alias("partition_key"), (F.col(number) % 5 == 0).alias("is_partition"), (F.col(number) % 7 == 0).alias("unlogged")]
        return tables.table(spark, d, "part").select(F.col("p_partkey").alias("table_name"), *facts)

    return diff.refusals(side(3, "p_size"), side(4, "p_partkey"))


@query(
    """SELECT 't' || p_partkey % 20 AS table_name, 'c' || p_partkey // 20 AS column_name, CASE WHEN p_size % 4 = 0 THEN 'sequence-default' ELSE 'collation' END AS refusal
  FROM part WHERE p_partkey % 7 = 0 AND (p_size % 4 = 0 OR p_size % 3 = 0)"""
)
def diff_refused_columns(spark, d):
    part = tables.table(spark, d, "part")
    names = [F.concat(F.lit("t"), F.col("p_partkey") % 20).alias("table_name"), F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 20)).alias("column_name")]
    desired = part.select(*names, (F.col("p_size") % 4 == 0).alias("sequence_default"), F.when(F.col("p_size") % 3 == 0, "C").alias("collation"))
    return diff.refused_columns(part.filter("p_partkey % 7 <> 0").select(*names), desired)


# --- catalog queries

@query("SELECT r_name, count(n_nationkey) AS n_nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name > 'F' GROUP BY r_name")
def catalog_left_join(spark, d):
    nation = tables.table(spark, d, "nation").filter("n_name > 'F'")
    joined = tables.table(spark, d, "region").join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("n_nations"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def catalog_anti_join(spark, d):
    orders = tables.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return tables.table(spark, d, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS referenced FROM nation")
def catalog_referenced_by(spark, d):
    rich = tables.table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("there", F.lit(True))
    return tables.table(spark, d, "nation").join(rich, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("there", F.lit(False)).alias("referenced"))


@query("SELECT r_name, n_name, count(*) AS n_customers, max(c_acctbal) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
def catalog_three_way_join(spark, d):
    t = lambda name: tables.table(spark, d, name)
    joined = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_customers"), F.max("c_acctbal").alias("balance"))


@query("SELECT n_nationkey, (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1) AS first_supplier FROM nation")
def catalog_first_match(spark, d):
    first = tables.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("first_supplier"))
    return tables.table(spark, d, "nation").join(first, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "first_supplier")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey = l_suppkey")
def catalog_two_key_outer_join(spark, d):
    orders = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"), "o_orderstatus")
    return tables.table(spark, d, "lineitem").join(orders, ["l_orderkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT table_name, count(*) AS n_columns FROM information_schema.columns WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem','events') GROUP BY table_name")
def catalog_columns(spark, d):
    return tables.columns(spark, d).groupBy("table_name").agg(F.count("*").alias("n_columns"))


# --- copies and changes: events are changes of users, in the order of time and id

_TEXTS = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
_ORDERS = f"md5({_TEXTS})"
_HASHED = f"(SELECT o_orderkey // 1000 AS chunk, CAST(('0x' || substr({_ORDERS}, 1, 15)) AS BIGINT) AS h FROM orders)"
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"SELECT chunk, count(*) AS n, bit_xor(h) AS x, CAST(sum(h % 1000000000) AS BIGINT) AS s FROM {_HASHED} GROUP BY chunk")
def chunk_checksum(spark, d):
    return copy.checksum(copy.chunked(tables.table(spark, d, "orders"), "o_orderkey", 1000), _COLUMNS, ["chunk"])


def _damaged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """orders, and a copy with an altered row, a missing one, and a pair of equal rows too many, which an xor alone does not see."""
    orders = tables.table(spark, d, "orders").select(*_COLUMNS)
    twice = orders.filter("o_orderkey = 1001")
    altered = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 7, "?").otherwise(F.col("o_orderstatus")))
    return orders, altered.filter("o_orderkey <> 500").unionByName(twice).unionByName(twice)


@query("SELECT DISTINCT o_orderkey // 250 AS chunk FROM orders WHERE o_orderkey IN (7, 500, 1001)")
def divergent_chunks(spark, d):
    orders, bad = _damaged(spark, d)
    return copy.divergent_chunks(orders, bad, "o_orderkey", _COLUMNS, 250)


@query("SELECT CAST(NULL AS BIGINT) AS chunk WHERE false")
def checksum_gate(spark, d):
    orders, bad = _damaged(spark, d)
    mended = copy.repaired(orders, bad, "o_orderkey", 250, copy.divergent_chunks(orders, bad, "o_orderkey", _COLUMNS, 250))
    return copy.divergent_chunks(orders, mended, "o_orderkey", _COLUMNS, 250)


@query("SELECT o_orderkey // 1000 AS chunk, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders GROUP BY 1")
def chunk_ranges(spark, d):
    rows = copy.chunked(tables.table(spark, d, "orders"), "o_orderkey", 1000)
    return rows.groupBy("chunk").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def change_buffer_latest(spark, d):
    return copy.latest_changes(tables.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query(
    """WITH base AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
last AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, coalesce(l.event_id, b.event_id) AS event_id FROM base b FULL JOIN last l USING (user_id) WHERE l.event_type IS NULL OR l.event_type <> 'click'"""
)
def apply_changes(spark, d):
    events = tables.table(spark, d, "events")
    base = events.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    changes = events.filter("event_id % 2 = 1").select("user_id", "event_id", F.when(F.col("event_type") == "click", "delete").otherwise("upsert").alias("op"))
    return copy.applied(base, copy.latest_changes(changes, "user_id", ["event_id"]), "user_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def copy_never_overwrites(spark, d):
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    shadow = orders.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("C"))
    return copy.copied(orders, shadow, "o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE user_id <= (SELECT avg(user_id) FROM events)")
def watermark_discard(spark, d):
    events = tables.table(spark, d, "events").select("event_id", "user_id")
    return copy.relevant(events, "user_id", events.agg(F.avg("user_id")).first()[0])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer")
def carried_forward(spark, d):
    change = F.when(F.col("c_custkey") % 10 == 1, "moved")
    value = copy.carried_forward(change, F.col("c_custkey") % 10 > 1, F.col("c_mktsegment"))
    return tables.table(spark, d, "customer").select("c_custkey", value.alias("segment"))


@query("SELECT CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS n WHERE false")
def unique_move_converges(spark, d):
    """Every customer takes the next one's number: unique at the end, although single changes in any order collide."""
    base = tables.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("slot"))
    changes = base.select("c_custkey", (F.col("slot") + 1).alias("slot"), F.lit("upsert").alias("op"))
    return validate.unique(copy.applied(base, changes, "c_custkey"), ["slot"])

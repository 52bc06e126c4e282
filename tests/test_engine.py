import hashlib
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ddlspark.functions.types import binary_coercible, fitted
from ddlspark.operators import copy, rewrite, validate
from ddlspark.plans import classify, diff
from ddlspark.streaming.changes import Shadow, stream


def test_three_valued_logic(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1), (3, 9), (None, 1), (None, 2)], "k int, v int")
    assert [r.k for r in validate.check(rows, F.col("v") > 0).collect()] == [3]
    assert [tuple(r) for r in validate.unique(rows, ["k"]).collect()] == [(3, 2)]
    assert {tuple(r) for r in validate.primary_key(rows, ["k"]).collect()} == {(3, 2), (None, 2)}
    assert validate.not_null(rows, "v").count() == 1
    parent = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert {r.v for r in validate.foreign_key(rows, parent, ["k"], ["id"]).collect()} == {-1, 9}
    assert {r.k for r in validate.partition_bound(rows, "k", 1, 3).collect()} == {3, None}


def test_type_rewrite_counts_failures(spark):
    rows = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert tuple(rewrite.failures(rows, "a", "int").first()) == (3, 1)
    assert [r.a for r in rewrite.retyped(rows, "a", "int").collect()] == [1, None, None]


@pytest.mark.parametrize(
    ("old", "new", "fits"),
    [("varchar(50)", "varchar(20)", False), ("character varying(5)", "varchar(9)", True), ("text", "varchar(9)", False), ("numeric(10,2)", "numeric", True), ("numeric", "numeric(10,2)", False), ("integer", "bigint", False), ("integer", "integer", True), ("decimal(10,2)", "numeric(12, 2)", True), ("numeric(10)", "numeric(12,0)", False), ("varchar(50)[]", "text", False), ("numeric(10,2)", "numeric(12,3)", False), (" VARCHAR (5) ", "text", True)],
)
def test_binary_coercible(spark, old, new, fits):
    assert spark.range(1).select(binary_coercible(F.lit(old), F.lit(new))).first()[0] is fits


def test_checksum_sees_a_pair_of_equal_rows(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    twice = one.unionByName(one.filter("k = 1")).unionByName(one.filter("k = 1"))
    assert copy.divergent_chunks(one, twice, "k", ["k", "v"], 10).count() == 1
    empty = one.withColumn("v", F.coalesce("v", F.lit("")))
    assert copy.divergent_chunks(one, empty, "k", ["k", "v"], 10).count() == 1


@pytest.mark.parametrize(("a", "b"), [(("a|b", "c"), ("a", "b|c")), ((None, "x"), ("\\N", "x")), (("1:a", ""), ("1", ":a")), (("-", None), (None, "-")), (("", "a"), ("a", ""))])
def test_checksum_tells_values_apart(spark, a, b):
    one, two = (spark.createDataFrame([(1, *x)], "k long, v string, w string") for x in (a, b))
    assert copy.divergent_chunks(one, two, "k", ["k", "v", "w"], 10).count() == 1


def test_null_keys_are_a_chunk(spark):
    one = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    assert copy.divergent_chunks(one, one, "k", ["k", "v"], 10).count() == 0
    other = spark.createDataFrame([(1, "a"), (None, "c"), (25, "d")], "k long, v string")
    bad = copy.divergent_chunks(one, other, "k", ["k", "v"], 10)
    assert {r.chunk for r in bad.collect()} == {None, 2}
    mended = copy.repaired(one, other, "k", 10, bad)
    assert {tuple(r) for r in mended.collect()} == {(1, "a"), (None, "b")}
    assert [(r.chunk, r.n) for r in copy.chunk_bounds(spark.range(100), "id", 4).orderBy("chunk").collect()] == [(0, 25), (1, 25), (2, 25), (3, 25)]


@pytest.mark.parametrize("name", ["a" * 63, "a" * 64, "é" * 60, "a" + "é" * 60, "a日" * 30, "😀" * 20, "x" + "😀" * 20])
def test_fitted_identifiers(spark, name):
    got = spark.createDataFrame([(name,)], "n string").select(fitted(F.col("n"))).first()[0]
    want = name if len(name.encode()) <= 63 else name.encode()[:54].decode("utf-8", "ignore") + "_" + hashlib.sha256(name.encode()).hexdigest()[:8]
    assert got == want and len(got.encode()) <= 63


# facts that differ from the plain ones, and what they lead to: reason, route and lint findings
GOLDEN = [
    ({"kind": "add column"}, "metadata-only", "native", []),
    ({"kind": "add column", "default_kind": "constant"}, "fast-default", "native", []),
    ({"kind": "add column", "default_kind": "expression"}, "volatile-default", "copy-and-swap", [("table-rewrite", "warning")]),
    ({"kind": "add column", "generated": True, "default_kind": "constant"}, "generated-stored", "copy-and-swap", [("table-rewrite", "warning")]),
    ({"kind": "drop column"}, "metadata-only", "native", [("destructive", "warning")]),
    ({"kind": "alter type", "old_type": "varchar(20)", "new_type": "text"}, "binary-coercible", "native", []),
    ({"kind": "alter type", "old_type": "integer", "new_type": "bigint"}, "type-rewrite", "copy-and-swap", [("table-rewrite", "warning")]),
    ({"kind": "alter type", "new_type": "text"}, "type-rewrite", "copy-and-swap", [("possible-table-rewrite", "warning")]),
    ({"kind": "alter type", "new_type": "text", "has_using": True}, "type-rewrite", "copy-and-swap", [("table-rewrite", "warning")]),
    ({"kind": "add constraint", "constraint_kind": "not null", "not_valid": True}, "online-idiom", "native", []),
    ({"kind": "add constraint", "constraint_kind": "not null"}, "safer-idiom", "native", [("blocking-idiom", "warning")]),
    ({"kind": "add constraint", "constraint_kind": "unique", "using_index": True}, "online-idiom", "native", []),
    ({"kind": "add constraint", "constraint_kind": "exclude"}, "unsupported-operation", "refuse", [("unsupported-operation", "error")]),
    ({"kind": "create index"}, "safer-idiom", "native", [("blocking-idiom", "warning")]),
    ({"kind": "create index", "concurrently": True}, "online-idiom", "native", []),
    ({"kind": "create partition"}, "partition-parent-lock", "native", []),
    ({"kind": "rename table"}, "app-breaking-rename", "native", [("app-breaking-rename", "warning")]),
]


def test_golden_decisions(spark):
    plain = {"default_kind": "none", "generated": False, "inline": "none", "old_type": None, "new_type": None, "has_using": False, "named": True, "not_valid": False, "using_index": False, "concurrently": False, "constraint_kind": "check"}
    names = ["stmt_id", "op_no", "kind", *plain]
    kinds = {"stmt_id": "long", "op_no": "int"} | {k: "boolean" for k, v in plain.items() if isinstance(v, bool)}
    facts = [tuple(({"stmt_id": k, "op_no": 0} | plain | g[0])[n] for n in names) for k, g in enumerate(GOLDEN)]
    decided = classify.classified(spark.createDataFrame(facts, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)))
    assert [(r.reason, r.route) for r in decided.orderBy("stmt_id").collect()] == [(g[1], g[2]) for g in GOLDEN]
    found = {}
    for r in classify.findings(decided).collect():
        found.setdefault(r.stmt_id, []).append((r.code, r.severity))
    assert [sorted(found.get(k, [])) for k in range(len(GOLDEN))] == [g[3] for g in GOLDEN]


MODEL = st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.sampled_from(["int", "text"]), st.booleans()), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(live=MODEL, desired=MODEL)
def test_diff_converges(spark, live, desired):
    make = lambda m: spark.createDataFrame([("t", c, t, n) for c, (t, n) in m.items()], "table_name string, column_name string, type string, nullable boolean")
    a, b = make(live), make(desired)
    after = diff.applied(a, b, diff.column_changes(a, b))
    assert diff.column_changes(after, b).count() == 0


def test_changes_stream_into_a_shadow(spark, tmp_path):
    shadow = Shadow(spark, str(tmp_path / "shadow"))
    os.makedirs(shadow.folder)
    shadow.publish(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), -1)
    incoming = str(tmp_path / "changes")
    schema = "seq long, op string, k long, v string"
    spark.createDataFrame([(0, "upsert", 1, "old"), (5, "upsert", 1, "x"), (6, "delete", 2, None), (7, "upsert", 3, "c"), (8, "upsert", 3, "d")], schema).write.parquet(incoming)
    shadow.apply(stream(spark, incoming, schema, start_after=0), "k").awaitTermination()
    assert {tuple(r) for r in shadow.read().collect()} == {(1, "x"), (3, "d")}
    spark.createDataFrame([(9, "upsert", 2, "again")], schema).write.mode("append").parquet(incoming)
    shadow.apply(stream(spark, incoming, schema, start_after=0), "k").awaitTermination()
    assert {tuple(r) for r in shadow.read().collect()} == {(1, "x"), (2, "again"), (3, "d")}

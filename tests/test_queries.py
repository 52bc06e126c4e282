"""Every engine query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from ddlspark import registry
from ddlspark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = [tuple(r[c] for c in order) for r in got.collect()]
    place = [want.columns.index(c) for c in order]
    expected = [tuple(r[k] for k in place) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_every_query_has_an_oracle():
    assert registry.queries().keys() == registry.oracle_sql().keys()

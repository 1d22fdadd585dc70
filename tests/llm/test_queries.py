"""Every registered query runs; those with SQL equal it."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from docketry import store
from docketry.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
NAMES = sorted(ORACLE_SQL)


def test_registered():
    assert set(QUERIES) <= set(driver.queries()) and {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name, results_only):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        duck.execute(f"create view {table} as from read_parquet('{SF_DIR}/{table}.parquet')")
    df = driver.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE_SQL[name]).project(",".join(columns)).fetchall()
    ordered = lambda rows: sorted(tuple(repr(v) for v in r) for r in rows)
    assert ordered(df.select(*columns).collect()) == ordered(expected)


@pytest.mark.parametrize("name", ["op4_quality_rules", "op7_url_filter"])
def test_native_plans_have_no_python(spark, name, monkeypatch):
    plans, write = [], store._write

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, *args)

    monkeypatch.setattr(store, "_write", watched)
    plans.append(QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString())
    plan = "\n".join(plans)
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan]

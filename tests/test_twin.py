"""All registered queries against their SQL in DuckDB, and rules every result must keep."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from docketry.constants import HAND_ENTERED_OFFENCES, PLEA_TEXTS
from docketry import store
from docketry.plans.report import report
from docketry.twin import tables as twin_tables
from docketry.twin.oracle import ORACLE_SQL
from docketry.twin.queries import QUERIES
from docketry.twin.tables import charge_tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("lineitem", "orders", "part"):
        connection.execute(f"create view {table} as from read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


@pytest.fixture(scope="module")
def tables(spark):
    return charge_tables(spark, SF_DIR)


def in_order(rows):
    return sorted(tuple(repr(v) for v in row) for row in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(driver.queries()) and set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    relation = duck.sql(driver.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    assert in_order(df.select(*columns).collect()) == in_order(
        relation.project(",".join(columns)).fetchall()
    )


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "Window", "ExistingRDD")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join_python_or_window(spark, name):
    plan = driver.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]


@pytest.fixture
def fresh_build(spark, monkeypatch):
    """The tables built anew, with the executed plan of every frame that is written."""
    plans = {}
    write = store._write

    def watched(df, name, *args):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *args)

    monkeypatch.setattr(store, "_write", watched)
    monkeypatch.setattr(twin_tables, "_built", {})
    return plans


def test_written_frames_have_no_cross_join_python_or_window(spark, fresh_build):
    for query in QUERIES.values():
        query(spark, SF_DIR)
    windows = [plan for plan in fresh_build.values() if "Window" in plan]
    unbounded = [plan for plan in windows if plan.count("windowspecdefinition(") > plan.count("windowspecdefinition(_part")]
    assert windows and not unbounded
    others = [node for node in UNWANTED if node != "Window"]
    assert not [(name, node) for name, plan in fresh_build.items() for node in others if node in plan]
    assert "hashpartitioning(data_part" not in fresh_build["charges"]


def test_every_table_is_written_once(spark, fresh_build, tmp_path, monkeypatch):
    monkeypatch.setattr("docketry.store.shared_folder", lambda spark: str(tmp_path))
    for _ in range(3):
        for query in QUERIES.values():
            query(spark, SF_DIR)
    written = [p.name.rsplit("_", 1)[0] for p in next((tmp_path / "docketry").iterdir()).iterdir()]
    twice = {name for name in written if written.count(name) > 1}
    assert twice <= {"surviving"} and written.count("surviving") == 2  # with and without the first row kept


def test_making_a_report_writes_nothing(spark, fresh_build):
    tables = charge_tables(spark, SF_DIR)
    before = len(fresh_build)
    assert len(report(tables)) > 40 and len(fresh_build) == before


def test_fixed_values_occur_in_results(spark):
    texts = {r.offense_description for r in charge_tables(spark, SF_DIR).fact().select("offense_description").collect()}
    assert set(HAND_ENTERED_OFFENCES.values()) <= texts
    pleas = {r.plea_description for r in QUERIES["relabel_parts"](spark, SF_DIR).collect()}
    assert set(PLEA_TEXTS.values()) <= pleas


def test_scans_read_the_needed_columns_only(tables):
    plan = tables.charges.groupBy("result_description").count()._jdf.queryExecution().toString()
    assert plan.count("ReadSchema: struct<result_description:string>") == 2
    assert "PartitionFilters: [isnotnull(interim" in plan


def test_entry(spark):
    assert driver.entry(spark).columns == ["result_description", "n", "pct"]


def test_removal_only_takes_interim_rows(tables):
    removed = tables.all_charges.select("row_order", "result_description").exceptAll(
        tables.charges.select("row_order", "result_description")
    )
    results = [r.result_description for r in removed.collect()]
    assert set(results) == {"Held To Answer in Superior Court"}
    assert tables.all_charges.count() - tables.charges.count() == len(results)


def test_ids_and_tags_are_never_missing(tables):
    columns = ["charge_id", "person_id", "case_id", "code_section", "code_section_m_f", "key",
               "age_group", "wobbler", "low_level", "svf"]
    missing = tables.all_charges.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    assert set(missing.collect()[0]) == {0}


def test_texts_do_not_change_the_row_count(tables):
    assert tables.fact().count() == tables.charges.count()


def test_persons_with_gaps_have_no_share(tables):
    """Skipping missing results would find more persons with half their charges dismissed."""
    strict = tables.persons.filter("pct_dismissed >= 0.5").count()
    dismissed = F.count_if(F.col("result_description") == "Dismissed")
    known = F.count("result_description")
    naive = tables.charges.groupBy("person_id").agg((dismissed / F.nullif(known, F.lit(0))).alias("p"))
    assert naive.filter("p >= 0.5").count() > strict

"""All queries again on records in which one charge holds a third of the rows, without broadcasts."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from docketry.operators.superseded import salted, superseded_keys
from docketry.plans.keys import charge_id
from docketry.store import materialise
from docketry.twin.oracle import ORACLE_SQL
from docketry.twin.queries import QUERIES
from docketry.twin.tables import charge_rows, charge_tables
from tests.test_twin import SF_DIR, in_order, pytestmark  # noqa: F401

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    # small enough for the fixture's hot partition to count as skewed
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    hot = "hash(l_orderkey, l_linenumber, l_extendedprice) % 3 = 0"
    first = f"from read_parquet('{SF_DIR}/lineitem.parquet')"
    connection.execute(f"""
        create table lineitem as select * replace (
          case when {hot} then (select min(l_orderkey) {first}) else l_orderkey end as l_orderkey,
          case when {hot} then (select min(l_partkey) {first}) else l_partkey end as l_partkey,
          case when {hot} then (select min(l_suppkey) {first}) else l_suppkey end as l_suppkey)
        {first}""")
    for table in ("orders", "part"):
        connection.execute(f"create table {table} as from read_parquet('{SF_DIR}/{table}.parquet')")
    for table in ("orders", "part"):
        connection.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    # Several files, since a heavy key is split between the tasks that read it.
    (folder / "lineitem.parquet").mkdir()
    for i in range(8):
        rows = f"(from lineitem where hash(l_extendedprice, l_linenumber) % 8 = {i})"
        connection.execute(f"copy {rows} to '{folder}/lineitem.parquet/{i}.parquet' (format parquet)")
    return connection, str(folder)


@pytest.fixture(scope="module")
def skewed(spark, duck):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield duck[1]
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_charge_holds_a_third(duck):
    ids = driver.oracle_sql()["composite_ids"]
    sizes = f"select count(*) as n from ({ids}) group by charge_id"
    ((rows, most),) = duck[0].sql(f"select sum(n), max(n) from ({sizes})").fetchall()
    assert most > 0.3 * rows


def test_heavy_keys_of_both_joins_are_split(spark, skewed):
    rows = charge_rows(spark, skewed).agg(F.max("plea"), F.max("case_level"), F.max("code"))
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("SortMergeJoin(skew=true)") == 2


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_interim_rows_of_a_heavy_charge_are_split(spark, skewed, adaptive):
    """Without broadcasts and whether or not Spark splits at run time: no join partition gets the heavy charge whole."""
    tables = charge_tables(spark, skewed)
    rows = tables.stored.withColumn("charge_id", charge_id())
    superseded = materialise(superseded_keys(rows, "charge_id", F.col("interim")), "superseded")
    heavy = superseded.agg(F.max("interim_rows")).first()[0]
    interim = rows.filter("interim")
    assert heavy > 0.2 * interim.count()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        dealt, keys = salted(interim, superseded, "charge_id", "row_order", rows_per_salt=heavy // 16)
        kept = dealt.join(keys.select("charge_id", "_salt"), ["charge_id", "_salt"], "left_anti")
        assert "hashpartitioning(charge_id" in (plan := kept._jdf.queryExecution().executedPlan().toString())
        assert "_salt#" in plan and "NestedLoop" not in plan
        sizes = dealt.repartition(16, "charge_id", "_salt").groupBy(F.spark_partition_id()).count().agg(F.max("count"))
        whole = dealt.repartition(16, "charge_id").groupBy(F.spark_partition_id()).count().agg(F.max("count"))
        assert sizes.first()[0] < 0.5 * heavy < heavy <= whole.first()[0]
        plain = interim.join(superseded.select("charge_id"), "charge_id", "left_anti")
        assert kept.select("row_order").exceptAll(plain.select("row_order")).count() == 0 and kept.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_on_skewed_records(spark, duck, skewed, name):
    df = QUERIES[name](spark, skewed)
    columns = sorted(df.columns)
    expected = duck[0].sql(ORACLE_SQL[name]).project(",".join(columns)).fetchall()
    assert in_order(df.select(*columns).collect()) == in_order(expected)

"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tests.oracle import TESTDATA, connect, difference
from workload import ORACLES, QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize(
    "name",
    ["build_matrix", "build_tasks", "device_capability", "compare_to_baseline", "merge_tile_results",
     "resource_stats", "gap_batches", "priority_batches", "route_comparison", "tier_and_resolution"],
)
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_hash_aggregation_for_latest_sample(spark):
    plan = QUERIES["resource_stats"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_only_read_columns_reach_the_scan(spark):
    plan = QUERIES["stage_stats_many_runs"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan and "l_quantity" in plan


def test_every_document_is_one_file_in_one_folder(spark, tmp_path):
    from workload import sources

    rows = spark.range(2_000).selectExpr("string(id) AS name", "id % 7 AS n")
    documents = sources.by_document(rows, "name").agg(F.to_json(F.collect_list("name")).alias("value"))
    sources.file_each(documents.select("value")).text(str(tmp_path / "documents"))
    read = spark.read.text(str(tmp_path / "documents"), wholetext=True)
    assert read.inputFiles() and not [p for p in (tmp_path / "documents").iterdir() if p.is_dir()]
    found = read.select(F.input_file_name().alias("file"), F.from_json("value", "array<string>").alias("names")).collect()
    assert len({r.file for r in found}) == len(found) == documents.count() <= 8
    assert sorted(n for r in found for n in r.names) == sorted(str(i) for i in range(2_000))

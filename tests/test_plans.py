"""Physical-plan properties of the registered queries."""

import re

import pytest

from tests.conftest import SF001
from tests.plan_tools import plan_text
from tendril.registry import QUERIES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_and_no_python_in_batch_plans(spark, name):
    p = plan_text(QUERIES[name](spark, SF001), "formatted")
    assert not [f for f in FORBIDDEN if f in p]


def test_top_k_per_key_limits_before_the_shuffle(spark):
    p = plan_text(QUERIES["plant_detail_events"](spark, SF001), "simple")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_latest_per_plant_is_partially_aggregated(spark):
    p = plan_text(QUERIES["growth_statistics"](spark, SF001), "simple")
    assert "partial_max_by" in p and "partial_min_by" in p


def test_filters_and_columns_reach_the_scan(spark):
    # (the measurement role computes its date from three columns, so its look-back
    # filter is checked on stored tables, in test_sources_changes.py)
    p = plan_text(QUERIES["event_search"](spark, SF001), "formatted")
    assert "GreaterThanOrEqual(o_orderdate," in p and "LessThan(o_orderdate," in p
    p = plan_text(QUERIES["active_plants"](spark, SF001), "formatted")
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in p
    p = plan_text(QUERIES["image_list"](spark, SF001), "formatted")
    assert "text:" not in p  # the documents' text column is never read


@pytest.mark.parametrize("name", ["dq_violations", "dq_summary"])
def test_quality_checks_join_the_plants_once(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_text(QUERIES[name](spark, SF001), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"SortMergeJoin \[plant_id#\w+\], \[_plant#", p)) == 1
    # the rest builds the type tables' roles and looks for their repeated names
    assert p.count("SortMergeJoin") <= 7 and p.count("Exchange hashpartitioning") <= 15

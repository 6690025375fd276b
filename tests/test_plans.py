"""What plans may not have, and what they should."""

import re

import pytest

from kelpforge.operators import features
from kelpforge.plans import catalog, records  # noqa: F401

SF = "/root/testdata/sf0.001"
#: Queries that read eagerly, end in a written table, or join a table with one row of totals.
ONE_ROW = {"independence_three_groups", "search_page", "fidelity", "evaluation_summary", "current_epoch", "workforce_summary", "scheduled_checks", "attrition_scores", "top_driver", "ranker_report", "two_tower_evaluation", "index_recall", "alert_states", "stored_ledger_verified"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("stream_") and n not in ONE_ROW))
def test_no_cross_joins(spark, name):
    found = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan(catalog.QUERIES[name](spark, SF)))
    assert not found


def test_point_in_time_is_one_sorted_pass(spark):
    text = plan(catalog.QUERIES["point_in_time"](spark, SF))
    assert "Join" not in text and text.count("Window ") == 1 and "Python" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["search_page"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "o_orderpriority" not in text and "o_orderdate" not in text


def test_caps_limit_before_the_window(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["newest_events_per_user"](spark, SF))


def test_leakage_needs_no_inequality_join(spark):
    view = features.FeatureView("v", [features.Feature("a")])
    e = spark.createDataFrame([("x", None, 1.0)], "entity_id string, label_time timestamp, a double")
    w = spark.createDataFrame([("x", None, 0, {"a": 1.0})], "entity_id string, event_time timestamp, write_seq long, values map<string,double>")
    assert "NestedLoop" not in plan(features.leaked(view, e, w))

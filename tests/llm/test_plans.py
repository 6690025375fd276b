"""Native operators run no Python; no operator crosses tables."""

import re

import pytest

from kelpforge.llm import queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op5_secret_scan", "op8_exact_dedup", "op9_url_filter", "op10_decontaminate"])
def test_native(spark, name):
    assert not re.search(r"Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_no_cross_joins(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(queries.QUERIES[name](spark, SF)))


def test_url_filter_does_not_shuffle(spark):
    assert "Exchange" not in plan(queries.QUERIES["op9_url_filter"](spark, SF))

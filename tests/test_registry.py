"""Changes of a registry and its hook; tools of actions."""

import pytest
from pyspark.sql import functions as F

from kelpforge.operators import governance

EVENTS = [("m", 1, 1, "DRAFT"), ("m", 1, 2, "LIVE"), ("m", 2, 3, "DRAFT"), ("m", 2, 4, "LIVE"), ("n", 1, 5, "DRAFT"), ("m", 2, 6, "ROLLED_BACK")]


def events(spark, n=6):
    return spark.createDataFrame(EVENTS[:n], "name string, version int, seq long, stage string")


def test_changes_tell_what_one_event_does_to_others(spark):
    told = lambda n, since: sorted(map(tuple, governance.stage_changes(events(spark, n), since).collect()))
    assert told(2, 1) == [("m", 1, "DRAFT", "LIVE")]
    assert told(4, 2) == [("m", 1, "LIVE", "ARCHIVED"), ("m", 2, None, "LIVE")]
    assert told(6, 5) == [("m", 1, "ARCHIVED", "LIVE"), ("m", 2, "LIVE", "ROLLED_BACK")]
    assert told(6, 6) == []


def test_the_hook_is_called_once_for_each_change(spark):
    seen, since = [], 0
    for n in (2, 2, 4, 6):
        since = governance.on_change(events(spark, n), since, lambda c: seen.append({(r["name"], r["version"]): r["after"] for r in c.collect()}))
    assert since == 6 and seen == [{("m", 1): "LIVE"}, {("m", 1): "ARCHIVED", ("m", 2): "LIVE"}, {("m", 1): "LIVE", ("m", 2): "ROLLED_BACK", ("n", 1): "DRAFT"}]
    assert governance.on_change(events(spark, 0), 3, seen.append) == 3


def test_each_action_has_one_tool(spark):
    tools = governance.Tools()
    steps = spark.createDataFrame([(1, "mail", "a"), (2, "mail", None), (3, "score", "b"), (4, "fly", "c"), (5, None, "d")], "step_id long, action_type string, body string")
    assert {r["error"] for r in tools.invoke(steps).collect()} == {"no tool for this action"}
    tools.register("mail", lambda s: s.where("body IS NOT NULL").select("step_id", F.upper("body").alias("result")))
    tools.register("score", lambda s: s.select("step_id", F.length("body").alias("result")))
    with pytest.raises(ValueError):
        tools.register("mail", lambda s: s)
    got = {r["step_id"]: (r["result"], r["error"]) for r in tools.invoke(steps).collect()}
    assert got == {1: ("A", None), 2: (None, "the tool gave no result"), 3: ("1", None), 4: (None, "no tool for this action"), 5: (None, "no tool for this action")}

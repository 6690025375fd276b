"""Live drift, canary guard, exact KS tails, trees in expressions, calendars and row digests against plain loops."""

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforge.functions import numeric
from kelpforge.operators import calendar, features, governance, ledger, models, statistics
from kelpforge.streaming import guard, streams

NOON = datetime(2024, 3, 1, 12)


# Live drift


@pytest.fixture(scope="module")
def book(spark):
    rows = [("t", "w", f"r{k}", "s", "a", "x", "ann", "ALLOW", [], None, NOON, k) for k in range(5)]
    names = "tenant_id string, workflow string, run_id string, step string, action_type string, subject_id string, agent string, outcome string, reasons array<string>, approver string, recorded_at timestamp, write_seq long"
    return ledger.append(spark.createDataFrame(rows, names))


def checks(spark, book, served, trained_at="2024-02-20", **options):
    rng = random.Random(1)
    reference = spark.createDataFrame([(rng.gauss(0, 1), rng.random()) for _ in range(400)], "x double, y double")
    told = streams.scheduled_checks(book, reference, spark.createDataFrame(served, "x double, y double, at timestamp_ntz"), ["x", "y"], trained_at, "2024-03-01 12:00:00", **options)
    return {r["name"]: (r["passed"], r["detail"]) for r in told.collect()}


def test_planted_drift_fails_the_check_and_asks_for_training(spark, book):
    rng = random.Random(2)
    same = [(rng.gauss(0, 1), rng.random(), NOON - timedelta(days=k % 29)) for k in range(300)]
    moved = [(x + 2, y, at) for x, y, at in same]
    old = [(x + 9, y, NOON - timedelta(days=31)) for x, y, _ in same]
    assert checks(spark, book, same + old) == {"ledger": (True, "0 broken chains"), "live_drift": (True, "300 rows, no drift"), "retrain": (True, "trained 10 days ago")}
    assert checks(spark, book, moved) == {"ledger": (True, "0 broken chains"), "live_drift": (False, "300 rows, drift of x"), "retrain": (False, "what is scored has drifted")}
    assert checks(spark, book, moved[:199] + [(None, 1.0, NOON)] * 50)["live_drift"] == (True, "199 rows are too few to tell")
    assert checks(spark, book, same, trained_at="2023-11-01")["retrain"] == (False, "trained 121 days ago")


def test_a_broken_chain_fails_the_check(spark, book):
    bad = book.withColumn("outcome", F.when(F.col("sequence") == 3, "DENY").otherwise(F.col("outcome")))
    assert checks(spark, bad, [])["ledger"] == (False, "1 broken chains")


# Guard


OUTCOME = "name string, arm string, version int, seq long, request_id string, clicked boolean, probability double, latency_ms double, is_credit boolean"


def outcomes(version, n, ctr, probability, latency, begin):
    rng = random.Random(version)
    rows = []
    for k in range(n):
        for j, (arm, p) in enumerate((("live", 0.3), ("canary", ctr))):
            rows.append(("m", arm, version, begin + 2 * k + j, f"{version}-{arm}-{k}", rng.random() < p, probability if arm == "canary" else 0.3, latency, False))
    return rows


def run(spark, folder, *files, **limits):
    for rows in files:
        spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(folder)
    return streams.drain(guard.guard(stream, guard.GuardLimits(**limits))).orderBy("seq").collect()


def test_a_bad_canary_is_stopped_and_the_registry_follows(spark, tmp_path):
    """Version 2 hardly gets clicks and is rolled back at the first check with enough impressions; version 3 does well and goes live."""
    told = run(spark, str(tmp_path / "in"), outcomes(2, 200, 0.05, 0.3, 20.0, 0), outcomes(2, 200, 0.05, 0.3, 20.0, 1000), outcomes(3, 420, 0.35, 0.33, 20.0, 5000), advance_after=400)
    of = lambda v: [(r["impressions"], r["stage"]) for r in told if r["version"] == v]
    assert of(2) == [(25 * k, "CANARY") for k in range(1, 12)] + [(300, "ROLLED_BACK")]
    assert of(3) == [(25 * k, "CANARY") for k in range(1, 16)] + [(400, "LIVE")]
    assert any("click-through" in x for r in told if r["stage"] == "ROLLED_BACK" for x in r["reasons"])
    decided = guard.registry_events(spark.createDataFrame(told, guard.DECISION))
    before = [("m", 1, -9, "LIVE", "ann", ""), ("m", 2, -2, "CANARY", "ann", ""), ("m", 3, 4999, "CANARY", "ann", "")]
    stages = governance.current_stages(spark.createDataFrame(before, decided.schema).unionByName(decided))
    assert {r["version"]: r["stage"] for r in stages.collect()} == {1: "ARCHIVED", 2: "ROLLED_BACK", 3: "LIVE"}


def test_enforcement_survives_a_batch_that_comes_again(spark, tmp_path):
    decisions = spark.createDataFrame([("m", 2, 9, 300, "ROLLED_BACK", ["slow"], 1.0, 0.0, 400.0), ("m", 2, 8, 275, "CANARY", [], 1.0, 0.0, 400.0)], guard.DECISION)
    write = guard.enforce(str(tmp_path / "registry"))
    write(decisions, 4)
    write(decisions, 4)
    assert [(r["version"], r["stage"], r["reason"]) for r in guard.enforced(spark, str(tmp_path / "registry")).collect()] == [(2, "ROLLED_BACK", "slow")]
    assert guard.enforced(spark, str(tmp_path / "none")).collect() == []


def test_each_reason_and_late_clicks():
    limits = guard.GuardLimits(minimum=10, keep=20, latencies=10)

    def arm(n, every, p, latency):
        a = guard._Arm(limits)
        for k in range(n):
            a.add(str(k), k % every == 0, p, latency)
        return a

    live = arm(20, 2, 0.5, 10.0)
    assert guard.verdict(live, arm(20, 2, 0.5, 10.0), limits)[0] == []
    assert [w.split(" is ")[0].rsplit(" ", 1)[0] for w in guard.verdict(live, arm(20, 5, 0.9, 300.0), limits)[0]] == ["click-through ratio", "calibration error", "p95 latency 300"]
    assert guard.verdict(live, arm(9, 9, 0.9, 300.0), limits)[0] == []
    late = arm(60, 1000, 0.1, 10.0)
    assert late.credit("59") and not late.credit("59") and late.credit("40") and not late.credit("39") and not late.credit("none")
    again = guard._Arm(limits, late.held())
    assert again.credit("41") and not again.credit("40") and again.clicks == 4 and len(again.ids) == 20


# Exact KS tails


def plain_tail(statistic, n, m):
    """The share of all orders of n and m rows whose gap reaches the statistic."""
    hit = total = 0
    for own in itertools.combinations(range(n + m), n):
        own, i, j, gap = set(own), 0, 0, 0.0
        for k in range(n + m):
            i, j = (i + 1, j) if k in own else (i, j + 1)
            gap = max(gap, abs(i / n - j / m))
        hit, total = hit + (gap >= statistic - 1e-12), total + 1
    return hit / total


@pytest.mark.parametrize("n,m", [(1, 1), (1, 5), (3, 4), (4, 6), (5, 5), (8, 8), (7, 8)])
def test_exact_tails_equal_enumeration(n, m):
    gaps = sorted({abs(i / n - j / m) for i in range(n + 1) for j in range(m + 1)})
    for d in gaps[:: max(1, len(gaps) // 6)] + [1.0]:
        assert numeric.two_sample_tail(d, n, m) == pytest.approx(plain_tail(d, n, m), abs=1e-12)


def test_exact_tails_meet_the_asymptotic_ones(spark):
    rows = [(0.05, 2000, 3000), (0.02, 9999, 10000), (0.2, 200, 150), (0.02, 20000, 20000)]
    got = spark.createDataFrame(rows, "d double, n long, m long").select("n", numeric.two_sample_p(F.col("d"), F.col("n"), F.col("m")).alias("p"), numeric.kolmogorov_p(F.col("d"), F.col("n"), F.col("m")).alias("q")).collect()
    assert all(abs(r["p"] - r["q"]) < 0.01 for r in got) and {r["p"] == r["q"] for r in got if r["n"] == 20000} == {True}
    values = spark.createDataFrame([("f", float(k), k >= 4) for k in range(8)] + [("g", 1.0, False)], "feature string, value double, is_live boolean")
    told = {r["feature"]: r["p_value"] for r in statistics.ks_test(values).collect()}
    assert told["f"] == pytest.approx(2 / math.comb(8, 4)) and told["g"] is None


# Trees


def plain_trees(nodes, base, rate, x):
    raw = base
    for t in range(len(nodes["feature"])):
        at = 0
        while nodes["feature"][t][at] >= 0:
            value = x[nodes["feature"][t][at]]
            left = value is not None and float(np.float32(value)) <= nodes["threshold"][t][at]
            at = nodes["left" if left else "right"][t][at]
        raw += rate * nodes["value"][t][at]
    return 1 / (1 + math.exp(-raw))


def random_trees(rng, trees, depth, width):
    size = 2 ** (depth + 1) - 1
    held = {c: np.zeros((trees, size), int if c in ("feature", "left", "right") else float) for c in ("feature", "threshold", "left", "right", "value")}
    for t in range(trees):
        for k in range(size):
            inner = k < size // 2 and (k == 0 or rng.random() < 0.8)
            held["feature"][t][k] = rng.randrange(width) if inner else -1
            held["threshold"][t][k], held["value"][t][k] = rng.choice([0.1, 0.5, rng.random()]), rng.gauss(0, 1)
            held["left"][t][k], held["right"][t][k] = (2 * k + 1, 2 * k + 2) if inner else (0, 0)
    return held


def test_trees_are_walked_as_plain_loops_walk_them(spark):
    rng = random.Random(3)
    nodes = random_trees(rng, 7, 4, 3)
    rows = [tuple(rng.choice([0.1, 0.5, None, rng.random()]) for _ in range(3)) for _ in range(200)]
    scored = spark.createDataFrame(rows, "a double, b double, c double").select(models.score_trees(nodes, 0.2, 0.3, [F.col(c) for c in "abc"]).alias("p"))
    assert [r["p"] for r in scored.collect()] == pytest.approx([plain_trees(nodes, 0.2, 0.3, x) for x in rows], abs=1e-12)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()


# Calendars


def test_free_time_and_slots_equal_minutes(spark):
    rng = random.Random(4)
    interval = lambda most: (lambda s: (s, s + rng.randrange(most)))(rng.randrange(100))
    hours = [(o, *interval(60)) for o in "abc" for _ in range(3)]
    busy = [(o, *interval(15)) for o in "abcd" for _ in range(8)] + [("a", 50, 40), ("b", None, 9), (None, 1, 2)]
    df = lambda rows: spark.createDataFrame(rows, "owner string, start long, end long")
    inside = lambda rows, o, t: any(x == o and s is not None and s <= t < e for x, s, e in rows)

    def stretches(holds):
        out = []
        for o in "abcd":
            t = 0
            while t < 200:
                begin = t
                while t < 200 and holds(o, t):
                    t += 1
                out += [(o, begin, t)] if t > begin else []
                t += 1
        return out

    want = stretches(lambda o, t: inside(hours, o, t) and not inside(busy, o, t))
    free = calendar.free(df(hours), df(busy))
    assert sorted(map(tuple, free.collect())) == want
    assert sorted(map(tuple, calendar.merged(df(busy)).collect())) == stretches(lambda o, t: inside(busy, o, t))
    cut = [(o, s + 4 * k, s + 4 * k + 4) for o, s, e in want for k in range((e - s) // 4)]
    assert sorted(map(tuple, calendar.slots(free, 4).collect())) == cut
    asked = [(o, k, k % 2) for o in "abz" for k in range(30)]
    given = calendar.assign(spark.createDataFrame(asked, "owner string, request int, priority int"), calendar.slots(free, 4)).collect()
    assert len(given) == 90
    for o in "abz":
        own, order = [c[1] for c in cut if c[0] == o], sorted((p, r) for x, r, p in asked if x == o)
        assert {r["request"]: r["start"] for r in given if r["owner"] == o} == {r: own[k] if k < len(own) else None for k, (_, r) in enumerate(order)}
    assert calendar.free(df([]), df(busy)).collect() == []
    with pytest.raises(ValueError):
        calendar.slots(free, 0)


# Row digests


def digest(spark, rows, schema="a string, b string"):
    return features.data_fingerprint(spark.createDataFrame(rows, schema)).first()["fingerprint"]


def test_digests_see_rows_not_their_order(spark):
    rows = [(str(k), None if k % 3 else "x") for k in range(40)]
    assert digest(spark, rows) == digest(spark, rows[::-1]) != digest(spark, rows + rows[:1])
    assert len({digest(spark, r) for r in ([("ab", "c")], [("a", "bc")], [("", None)], [(None, "")], [(None, None)], [("1:a", "")], [])}) == 7


def test_a_collision_of_64_bit_sums_is_told_apart(spark):
    """Two pairs of numbers, found by a birthday search, whose 64-bit hashes have one sum modulo 2^32 and one XOR of high parts wouldn't differ there."""
    hashed = spark.range(60_000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1 << 24)).alias("h"))
    same = hashed.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").first()
    weak = lambda k: spark.createDataFrame([(k,)], "id long").agg(F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 24)))).first()[0]
    assert weak(same["a"]) == weak(same["b"])
    assert digest(spark, [(same["a"],)], "id long") != digest(spark, [(same["b"],)], "id long")


def test_impressions_counted_in_runs_leave_an_arm_as_one_by_one():
    import random

    import pandas as pd

    from kelpforge.streaming.guard import GuardLimits, _Arm

    rng = random.Random(5)
    limits = GuardLimits(keep=7, latencies=4)
    one, many = _Arm(limits), _Arm(limits)
    for size in (0, 3, 5, 20, 1, 7, 8, 2, 40, 6):
        rows = [(str(rng.randrange(12)), rng.random() < 0.4, rng.random(), rng.choice([float("nan"), rng.random()])) for _ in range(size)]
        for r in rows:
            one.add(*r)
        many.add_all(pd.DataFrame(rows, columns=["request_id", "clicked", "probability", "latency_ms"]))
        for r in map(str, rng.sample(range(12), 4)):
            assert one.credit(r) == many.credit(r)
        assert one.p95() == many.p95() and one.ctr() == many.ctr() and one.calibration_error() == many.calibration_error()
        assert one.held() == many.held()

"""Operators against plain models and at their boundaries."""

import datetime as dt
import hashlib
import hmac
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpforge.functions import hashing, numeric, text
from kelpforge.operators import features, governance, ledger, planning, privacy, ranking, retrieval, sentiment, statistics, tables

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# Point in time

VIEW = features.FeatureView("v", [features.Feature("a"), features.Feature("b", 9.0)], ttl_seconds=100)
WRITES = "entity_id string, event_time timestamp, write_seq long, values map<string,double>"


def plain_as_of(writes, entity, moment, view):
    out = {}
    for f in view.features:
        seen = [(w[1], -w[2], w[3][f.name]) for w in writes if w[0] == entity and w[3].get(f.name) is not None and at(moment - view.ttl_seconds) <= w[1] <= at(moment)]
        out[f.name] = max(seen)[2] if seen else f.default
    return out


@pytest.mark.parametrize("embargo", [0, 30])
def test_point_in_time_against_a_plain_fold(spark, embargo):
    rng = random.Random(4)
    writes = [(rng.choice("xyz"), at(rng.randrange(0, 400, 5)), k, rng.choice([{"a": float(k)}, {"b": float(k)}, {"a": float(k), "b": None}, {"a": 0.0, "b": 9.0}])) for k in range(150)]
    labels = [(rng.choice("xyzw"), at(s), s) for s in range(0, 500, 7)]
    got = features.point_in_time_join(VIEW, spark.createDataFrame(labels, "entity_id string, label_time timestamp, n long"), spark.createDataFrame(writes, WRITES), embargo).collect()
    assert len(got) == len(labels)
    for r in got:
        assert {"a": r.a, "b": r.b} == plain_as_of(writes, r.entity_id, r.n - embargo, VIEW), r


def test_point_in_time_edges(spark):
    writes = spark.createDataFrame([("x", at(100), 0, {"a": 1.0}), ("x", at(100), 1, {"a": 2.0}), ("x", at(301), 2, {"a": 3.0})], WRITES)
    labels = spark.createDataFrame([("x", at(s)) for s in (99, 100, 200, 201, 300, 301)], "entity_id string, label_time timestamp")
    got = {int(r.label_time.replace(tzinfo=dt.timezone.utc).timestamp() - T0.timestamp()): r.a for r in features.point_in_time_join(VIEW, labels, writes).collect()}
    assert got == {99: 0.0, 100: 1.0, 200: 1.0, 201: 0.0, 300: 0.0, 301: 3.0}
    assert features.point_in_time_join(VIEW, labels, writes.limit(0)).where("a <> 0 OR b <> 9").count() == 0
    assert features.point_in_time_join(VIEW, labels.limit(0), writes).count() == 0


def test_latest_without_and_with_a_moment(spark):
    writes = spark.createDataFrame([("x", at(0), 0, {"a": 1.0}), ("x", at(500), 1, {"b": 2.0})], WRITES)
    assert features.latest(VIEW, writes).collect()[0].asDict() == {"entity_id": "x", "a": 1.0, "b": 2.0}
    assert features.latest(VIEW, writes, "2024-01-01 00:08:20").collect()[0].asDict() == {"entity_id": "x", "a": 0.0, "b": 2.0}


def test_leakage(spark):
    writes = spark.createDataFrame([("x", at(10), 0, {"a": 5.0}), ("x", at(50), 1, {"a": 7.0}), ("x", at(60), 2, {"a": 5.0})], WRITES)
    examples = spark.createDataFrame([("x", at(20), 5.0, 9.0), ("x", at(30), 7.0, 9.0), ("x", at(40), 0.0, 9.0), ("x", at(55), 7.0, 9.0)], "entity_id string, label_time timestamp, a double, b double")
    assert [r.value for r in features.leaked(VIEW, examples, writes).collect()] == [7.0]
    with pytest.raises(ValueError):
        features.assert_no_leakage(VIEW, examples, writes)
    assert features.leaked(VIEW, examples, writes, 10).count() == 2


def test_views_are_checked(spark):
    with pytest.raises(ValueError):
        features.FeatureView("v", [features.Feature("a"), features.Feature("a")])
    with pytest.raises(ValueError):
        features.FeatureView("v", [features.Feature("a")], ttl_seconds=0)
    assert VIEW.undeclared(spark.createDataFrame([("x", at(0), 0, {"zz": 1.0, "a": 1.0})], WRITES)).collect()[0].feature == "zz"


def test_fingerprint_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k long, v string")
    one = features.data_fingerprint(a).first().fingerprint
    assert one == features.data_fingerprint(a.orderBy(F.desc("k"))).first().fingerprint
    assert one != features.data_fingerprint(a.distinct()).first().fingerprint


# Statistics


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "grp string, total long, selected long")


def test_four_fifths_boundaries(spark):
    told = lambda rows: {r.grp: r for r in statistics.four_fifths(outcomes(spark, rows)).collect()}
    exact = told([("a", 100, 50), ("b", 100, 40), ("c", 29, 0)])
    assert exact["b"].ratio == 0.8 and not exact["b"].impacted and exact["a"].verdict == "NO_ADVERSE_IMPACT" and not exact["c"].eligible
    assert told([("a", 1000, 500), ("b", 1000, 399)])["b"].impacted
    assert {r.verdict for r in told([("a", 100, 0), ("b", 100, 0)]).values()} == {"INSUFFICIENT_DATA"}
    assert {r.verdict for r in told([("a", 100, 50), ("b", 29, 1)]).values()} == {"INSUFFICIENT_DATA"}
    assert statistics.four_fifths(outcomes(spark, [])).count() == 0
    assert statistics.impact_summary(statistics.four_fifths(outcomes(spark, [("a", 100, 50), ("b", 100, 20)]))).first().worst == "b"


def test_chi_squared_tail():
    assert abs(numeric.chi_squared_tail(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(numeric.chi_squared_tail(18.307038053275146, 10) - 0.05) < 1e-12
    assert abs(numeric.chi_squared_tail(0.001, 1) - math.erfc(math.sqrt(0.0005))) < 1e-12
    for x in (0.1, 2.0, 30.0, 400.0):
        assert abs(numeric.chi_squared_tail(x, 2) - math.exp(-x / 2)) < 1e-14


def test_independence(spark):
    two = statistics.independence_test(outcomes(spark, [("a", 100, 30), ("b", 100, 50)])).first()
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((30, 40), (70, 60), (50, 40), (50, 60)))
    assert abs(two.statistic - want) < 1e-12 and two.dof == 1 and abs(two.p_value - math.erfc(math.sqrt(want / 2))) < 1e-12
    assert statistics.independence_test(outcomes(spark, [("a", 100, 0), ("b", 100, 0)])).first().p_value is None


def drift_frame(spark, reference, live):
    return spark.createDataFrame([("f", float(x), False) for x in reference] + [("f", float(x), True) for x in live], "feature string, value double, is_live boolean")


def plain_psi(reference, live, ends_first, bins=10):
    edges = np.quantile(reference, np.linspace(0, 1, bins + 1))
    if not ends_first:
        edges = np.unique(edges)
    edges[0], edges[-1] = -np.inf, np.inf
    edges = np.unique(edges)
    share = lambda x: np.clip(np.histogram(x, np.append(edges[:-1], np.inf))[0] / len(x), 1e-6, None)
    r, q = share(reference), share(live)
    return float(((q - r) * np.log(q / r)).sum())


@pytest.mark.parametrize("shift", [0.0, 1.0])
def test_both_psi_definitions(spark, shift):
    rng = np.random.default_rng(5)
    reference, live = rng.normal(0, 1, 500), rng.normal(shift, 1, 400)
    tied = np.round(np.clip(reference, -0.8, 0.8), 1)
    for ref, new in ((reference, live), (np.append(tied, rng.normal(0, 1, 30)), np.round(live, 1))):
        v = drift_frame(spark, ref, new)
        assert abs(statistics.psi_edges_first(v).first().psi - plain_psi(ref, new, True)) < 1e-9
        assert abs(statistics.psi_merge_first(v).first().psi - plain_psi(ref, new, False)) < 1e-9


def test_psi_small_cases(spark):
    assert statistics.psi_edges_first(drift_frame(spark, [1], [2])).first().psi == 0.0
    assert statistics.psi_edges_first(drift_frame(spark, [5] * 50, [5] * 50)).first().severity == "stable"
    assert statistics.psi_merge_first(drift_frame(spark, [5] * 50, [6] * 50)).first().psi == 0.0
    assert statistics.psi_merge_first(drift_frame(spark, [1, 2], [1, 2])).count() == 0
    snapped = statistics.psi_edges_first(drift_frame(spark, [0, 0, 2, 2], [1, 1, 1, 3])).first().psi  # 1 is as near to 0 as to 2
    assert abs(snapped - (0.25 * math.log(0.75 / 0.5) - 0.25 * math.log(0.25 / 0.5))) < 1e-9


def test_ks(spark):
    got = statistics.ks_test(drift_frame(spark, range(100), range(50, 150))).first()
    assert got.statistic == 0.5 and got.severity == "SIGNIFICANT" and got.p_value < 1e-6
    same = statistics.ks_test(drift_frame(spark, range(100), range(100))).first()
    assert same.statistic == 0 and same.p_value == 1.0 and same.severity == "STABLE"
    drifted = statistics.drift_verdict(drift_frame(spark, range(200), range(100, 300))).first()
    assert drifted.drifted and statistics.worst_severity(statistics.drift_verdict(drift_frame(spark, range(200), range(200)))).first().worst == "stable"


def test_calibration_edges_and_auc_ties(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.1 + 1e-12, 0), (1.0, 1), (0.30000000000000004, 0)], "p double, y int")
    ece = statistics.calibration_error(rows, "p", "y").first().ece
    assert abs(ece - (2 * abs(0.05 - 0.5) + 1 * 0.1 + 0.3 + 0.0) / 5) < 1e-9
    tie = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.7, 1), (0.2, 0)], "s double, y int")
    assert statistics.roc_auc(tie, "s", "y").first().auc == 0.875
    assert statistics.roc_auc(tie.where("y = 1"), "s", "y").first().auc == 0.5


def test_variants_and_buckets(spark):
    want = int.from_bytes(hashlib.sha256(b"s:k:u7").digest()[:8], "big") / 2**64
    assert spark.range(1).select(hashing.bucket(F.lit("u7"), "k", "s")).first()[0] == want
    shares = spark.range(20_000).select(statistics.assign_variant(hashing.bucket(F.col("id").cast("string"), "k", "s"), [("a", 1), ("b", 3)], 0.2).alias("v")).groupBy("v").count().collect()
    n = {r.v: r["count"] / 20_000 for r in shares}
    assert abs(n["holdout"] - 0.2) < 0.02 and abs(n["a"] - 0.2) < 0.02 and abs(n["b"] - 0.6) < 0.02
    with pytest.raises(ValueError):
        statistics.assign_variant(F.lit(0.5), [("a", 0.0)])


def test_sequential_test_false_alarms(spark):
    rng = np.random.default_rng(7)
    rows = []
    for run in range(150):
        c, t = rng.random(3000) < 0.1, rng.random(3000) < 0.1
        rows += [(run, int(c[:n].sum()), n, int(t[:n].sum()), n) for n in range(100, 3001, 100)]
    got = statistics.mixture_sprt(spark.createDataFrame(rows, "run int, control_successes long, control_trials long, treatment_successes long, treatment_trials long"))
    stopped = got.where("decision IN ('TREATMENT_WINS', 'CONTROL_WINS')").select("run").distinct().count()
    assert stopped / 150 < 0.15
    win = statistics.mixture_sprt(spark.createDataFrame([(100, 1000, 200, 1000), (0, 0, 0, 0)], "control_successes long, control_trials long, treatment_successes long, treatment_trials long")).collect()
    assert [r.decision for r in win] == ["TREATMENT_WINS", "CONTINUE"]


def test_decayed_arms(spark):
    rewards = [1.0, 0.0, 0.5, 1.0, 0.0]
    a = b = 1.0
    for r in rewards:
        a, b = 1 + (a - 1) * 0.9 + r, 1 + (b - 1) * 0.9 + 1 - r
    got = statistics.beta_posterior(spark.createDataFrame([("x", r, k) for k, r in enumerate(rewards)], "arm string, reward double, k int"), "arm", "reward", "k", 0.9).first()
    assert abs(got.successes - a) < 1e-12 and abs(got.failures - b) < 1e-12


def test_guard(spark):
    rows = [("live", True, 0.5, 10.0)] * 300 + [("live", False, 0.5, 10.0)] * 300 + [("canary", k % 10 == 0, 0.5, 300.0) for k in range(400)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "window string, clicked boolean, probability double, latency_ms double, k long")
    w = statistics.serving_window(frame, "window", ["k"])
    v = statistics.rollout_verdict(w, "live", "canary").first()
    assert not v.healthy and len(v.reasons) == 3
    few = statistics.rollout_verdict(statistics.serving_window(frame, "window", ["k"], keep=100), "live", "canary").first()
    assert few.healthy


def test_determinism_and_fidelity(spark):
    rows = [("a", "x")] * 10 + [("b", "x")] * 19 + [("b", "y")] + [("c", "x")] * 7 + [("c", "y")] * 3 + [("d", o) for o in "uvwx"]
    got = statistics.determinism(spark.createDataFrame(rows, "case string, output string"), "case", "output")
    assert {r["case"]: r.stability for r in got.collect()} == {"a": "DETERMINISTIC", "b": "NEAR_DETERMINISTIC", "c": "UNSTABLE", "d": "NON_DETERMINISTIC"}
    drift = spark.createDataFrame([("f", "MODERATE", 0.2)], "feature string, severity string, statistic double")
    f = statistics.fidelity(got, drift).first()
    assert abs(f.score - (0.6 * (1 + 0.85 + 0.45) / 4 + 0.4 * 0.6)) < 1e-12 and f.gate == "BLOCK" and len(f.findings) == 3
    with pytest.raises(Exception, match="fidelity needs"):
        statistics.fidelity(got.limit(0), drift.limit(0)).first()


# Ranking and retrieval


def test_list_metrics(spark):
    lists = spark.createDataFrame([("q", "a", 1, 3), ("q", "b", 2, 0), ("q", "c", 3, 2), ("z", "a", 1, 0)], "q string, item string, rank int, rel int")
    got = {r.q: r for r in ranking.ndcg(lists, "q", "rank", "rel", 2).collect()}
    assert abs(got["q"].dcg - 7.0) < 1e-12 and abs(got["q"].ndcg - 7 / (7 + 3 / math.log2(3))) < 1e-12 and got["z"].ndcg == 0
    wanted = spark.createDataFrame([("q", "c"), ("q", "x"), ("y", "a")], "q string, item string")
    rp = {r.q: (r.recall, r.precision) for r in ranking.recall_precision(lists, wanted, "q", "item", "rank", 3).collect()}
    assert rp == {"q": (0.5, 1 / 3), "z": (0.0, 0.0), "y": (0.0, 0.0)}
    ap = {r.q: (r.rr, r.ap) for r in ranking.reciprocal_rank_and_ap(lists.union(lists), wanted, "q", "item", "rank").collect()}
    assert ap["q"] == (1 / 3, 1 / 6) and ap["z"] == (0.0, 0.0)


def test_diversity_and_rerank(spark):
    rows = [("r", f"i{k}", 1.0 - k / 100, "t" + str(k % 2), [1.0, float(k % 2)] if k != 3 else None) for k in range(8)]
    pool = spark.createDataFrame(rows, "request_id string, item_id string, score double, topic string, vector array<double>")
    got = ranking.rerank(pool, 5, 0.5).orderBy("position").collect()
    assert got[0].item_id == "i0" and len({r.item_id for r in got}) == 5 and got[1].item_id == "i3"
    explored = ranking.rerank(pool, 5, 0.5, explore=0.2).orderBy("position").collect()
    assert explored[-1].reason.startswith("explored") and explored == ranking.rerank(pool, 5, 0.5, explore=0.2).orderBy("position").collect()
    s = np.array([0.3, 0.9, 0.5])
    assert ranking.marginal_relevance(s, np.eye(3), 2, 1.0) == [1, 2] and ranking.marginal_relevance(s, np.eye(3), 0, 1.0) == []
    assert ranking.marginal_relevance(np.zeros(0), np.zeros((0, 0)), 3, 0.5) == []


def test_marginal_relevance_against_its_formula():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        scores, m = rng.random(n).round(1), rng.random((n, n)).round(1)
        m, trade, got = (m + m.T) / 2, float(rng.random()), []
        while len(got) < min(5, n):
            worth = {i: (trade * scores[i] - (1 - trade) * max(m[i, j] for j in got) if got else scores[i]) for i in range(n) if i not in got}
            got.append(next(i for i in worth if worth[i] == max(worth.values())))
        assert ranking.marginal_relevance(scores, m, 5, trade) == got


def test_exploration_takes_each_topics_best_rows_in_turn(spark):
    reserve = pd.DataFrame({"item_id": list("abcd"), "score": [4.0, 3.0, 2.0, 1.0], "topic": ["x", "y", "x", "x"]})
    got = ranking._explored(reserve, 4, {"x": (1e6, 1.0), "y": (1.0, 1e6)}, [1])
    assert list(zip(got["slot"], got["item_id"], strict=True)) == [(0, "a"), (1, "c"), (2, "d")]


def test_list_diversity_of_equal_vectors(spark):
    rows = [("r", f"i{k}", 1.0 - k / 100, "t" + str(k % 2), [1.0, float(k % 2)] if k != 3 else None) for k in range(8)]
    pool = spark.createDataFrame(rows, "request_id string, item_id string, score double, topic string, vector array<double>")
    d = ranking.intra_list_diversity(pool.where("item_id IN ('i0', 'i2')"), "request_id", "item_id", "vector").first()
    assert abs(d.diversity) < 1e-12


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8))
    m[5] = 0
    corpus = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(999, None)], "id long, vector array<double>")
    queries = corpus.where("id < 12")
    exact = retrieval.exact_neighbours(queries, corpus, 5, block=5)
    u = np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    for q in range(12):
        want = sorted(range(300), key=lambda i: (-round(float(u[q] @ u[i]), 12), i))[:5]
        assert [r.item_id for r in exact.where(F.col("query_id") == q).orderBy("rank").collect()] == want
    all_cells = retrieval.cell_neighbours(queries, corpus, 5, cells=6, probes=6)
    assert retrieval.recall_against(all_cells, exact).agg(F.min("recall")).first()[0] == 1.0
    some = retrieval.recall_against(retrieval.cell_neighbours(queries, corpus, 5, cells=6, probes=4), exact)
    assert some.agg(F.avg("recall")).first()[0] >= 0.9
    assert retrieval.exact_neighbours(queries.limit(0), corpus, 5).count() == 0


def test_leave_last_out(spark):
    rows = [("u", f"i{k}", 5.0, k) for k in range(6)] + [("v", "i0", 5.0, k) for k in range(4)] + [("u", "low", 1.0, 9), ("w", "i9", 5.0, 9)] + [("w", f"i{k}", 4.0, k) for k in range(4)]
    got = ranking.leave_last_out(spark.createDataFrame(rows, "u string, i string, r double, t long"), "u", "i", "r", "t").collect()
    part = {(r.u, r.i): r.part for r in got}
    assert "v" not in {r.u for r in got} and ("u", "low") not in part
    assert ("u", "i5") not in part and ("w", "i9") not in part and part[("w", "i3")] == "validation"


def test_target_rank_counts_ties_against(spark):
    s = spark.createDataFrame([("u", "a", 0.5), ("u", "b", 0.5), ("u", "c", 0.9), ("u", "seen", 1.0)], "u string, i string, s double")
    got = ranking.target_rank(s, spark.createDataFrame([("u", "seen")], "u string, i string"), spark.createDataFrame([("u", "a")], "u string, i string"), "u", "i", "s").first()
    assert got["rank"] == 3
    e = ranking.evaluation_summary(spark.createDataFrame([(k, 1 + k % 20) for k in range(200)], "u long, rank long"), "rank", 10, 200).first()
    assert e.hit == 0.5 and e.hit_low < 0.5 < e.hit_high


def test_caps_and_features(spark):
    rows = spark.createDataFrame([("l", "a", 3), ("l", "a", 2), ("l", "a", 1), ("l", "", 3), ("l", "", 2), ("l", None, 1)], "l string, k string, s int")
    assert ranking.cap_per_attribute(rows, "l", "k", [F.desc("s")], 1).count() == 4
    c = spark.createDataFrame([("u", "i", 0.4)], "user_id string, item_id string, retrieval_score double")
    got = ranking.candidate_features(c, spark.createDataFrame([("u", 1.0, 2.0)], "user_id string, x double, y double"), spark.createDataFrame([("i", 5.0)], "item_id string, y double"), ["x", "y", "z", "retrieval_score"]).first()
    assert (got.x, got.y, got.z, got.retrieval_score) == (1.0, 5.0, 0.0, 0.4)


# Text, privacy


def test_sentiment(spark):
    rows = [("g", "the manager is not helpful"), ("g", "good pay"), ("g", "nothing"), ("h", "bad")]
    got = sentiment.group_sentiment(spark.createDataFrame(rows, "grp string, text string"), "grp", "text", minimum=3)
    by = {(r.grp, r.aspect): r for r in got.collect()}
    assert by[("h", None)].suppressed and by[("h", None)].overall is None
    assert by[("g", "lead")].score == -1 and by[("g", "pay")].score == 1 and by[("g", "pay")].overall == 0
    worse = sentiment.early_warnings(got, got.withColumn("score", F.col("score") - 0.4)).collect()
    assert len(worse) == 2
    with pytest.raises(ValueError):
        sentiment.group_sentiment(got, "grp", "aspect", minimum=1)


PEOPLE = "national_id string, full_name string, email string, gender string, university string, graduation_date date, hired_on string, years int, summary string"


def test_anonymise(spark):
    df = spark.createDataFrame([("n1", "A B", "a@b.org", "f", " State U ", dt.date(2014, 7, 1), "2020-01-15x", 3, "mail a@b.org or +49 170 1234567"), (None, "C", "c@d.org", "m", "  ", None, "never", 1, None)], PEOPLE)
    policy = privacy.Policy("0123456789abcdef", 2024)
    clean, report = privacy.anonymise(df, policy)
    a, b = clean.collect()
    assert clean.columns == ["university", "graduation_years_ago", "hired_years_ago", "years", "summary", "subject_key"]
    assert a.subject_key == "subj_" + hashlib.sha256(b"0123456789abcdef:national_id:n1").hexdigest()[:16] and b.subject_key.startswith("subj_")
    assert a.university == "inst_" + hashlib.sha256(b"0123456789abcdef:pedigree:state u").hexdigest()[:8] and b.university == "UNSPECIFIED"
    assert a.graduation_years_ago == 9.5 and a.hired_years_ago == 4.0 and b.hired_years_ago is None
    assert a.summary == "mail [email] or [phone]" and "full_name" in report.pseudonymised and report.touched()[0] == "email"
    with pytest.raises(ValueError, match="email, gender"):
        privacy.assert_clean(["gender", "email", "x"], policy)
    with pytest.raises(ValueError):
        privacy.Policy("short", 2024)
    with pytest.raises(Exception, match="stable identifier"):
        privacy.anonymise(df.where("national_id IS NULL").withColumn("email", F.lit("")), policy)[0].collect()


def test_screening(spark):
    df = spark.createDataFrame([("a@b.org", 0.9, 0.5, 6.0), ("c@d.org", None, None, None)], "email string, skill_match double, assessment double, years_experience double")
    got = {r.score: r for r in privacy.screen(df, privacy.Policy("0123456789abcdef", 2024), "at least five years").collect()}
    want = round((0.9 * 2 + 0.5 + 1.0) / 4, 4)
    assert set(got) == {want, None} and got[want].recommendation == "ADVANCE" and got[None].recommendation == "HOLD"
    fenced = spark.createDataFrame([('```json\n{"score": 0.5, "recommendation": "REVIEW"}\n```',), ('{"score": 7, "recommendation": "REVIEW"}',), ("no json",)], "t string")
    assert [r.valid for r in privacy.parse_screening(fenced, "t").collect()] == [True, False, False]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.required_years(F.lit("role_requirement: 3+ years of x")).alias("a"), text.required_years(F.lit("role_requirement: none")).alias("b"), text.skill_tokens(F.lit("C++, node.js and spark-sql.")).alias("c"),
        text.normalise(F.lit('{"b": "é", "a": [1,  2]}'), "json").alias("d"), text.normalise(F.lit("no  json"), "json").alias("e"), text.spreadsheet_safe(F.lit("=1+1")).alias("f"), text.signals(F.lit("x: 1\ny: 0.5\nx: 2")).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (3.0, None, ["c", "node.js", "and", "spark-sql"], '{"a":[1,2],"b":"é"}', "no json", "'=1+1", {"x": 2.0, "y": 0.5})


@given(st.text(max_size=40), st.binary(min_size=1, max_size=90))
def test_canonical_form_is_injective_in_python(message, key):
    assert hmac.new(key, message.encode("utf-8", "surrogatepass"), "sha256").hexdigest()
    assert "".join(f"{len(p)}:{p}" for p in (message, "")) != "".join(f"{len(p)}:{p}" for p in ("", message)) or not message


def test_hmac_and_encodings(spark):
    key = b"k" * 70
    got = spark.range(1).select(hashing.hmac_sha256(key, F.lit("héllo")).alias("m"), hashing.length_prefixed(F.lit("é"), F.lit(None)).alias("c"), hashing.length_prefixed_list(F.array(F.lit("a"), F.lit("b|c"))).alias("r"), hashing.iso_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("t"), hashing.iso_timestamp(F.lit("2024-01-01 00:00:00.5").cast("timestamp")).alias("u")).first()
    assert got.m == hmac.new(key, "héllo".encode(), "sha256").hexdigest()
    assert (got.c, got.r, got.t, got.u) == ("1:é0:", "1:a3:b|c", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.500000+00:00")


# Planning


def plain_projection(h, a, hires, ramp, demand, months):
    cohorts, out = [], []
    h = float(h)
    for month in range(1, months + 1):
        leavers = h * a
        h -= leavers
        cohorts = [(s, n * (1 - a)) for s, n in cohorts]
        cohorts.append((month, float(hires)))
        h += hires
        young = [(s, n) for s, n in cohorts if month - s < ramp]
        effective = h - sum(n for _, n in young) + sum(n * (month - s) / ramp for s, n in young)
        out.append((month, h, effective, leavers))
    return out


@pytest.mark.parametrize("scenario", [("s", 100, 0.02, 3, 3, 100.0), ("s", 80, 0.05, 1, 0, 70.0), ("s", 10, 0.9, 0, 4, 5.0), ("s", 0, 0.0, 2, 12, 9.0)])
def test_projection_against_the_recurrence(spark, scenario):
    got = planning.project(spark.createDataFrame([scenario], planning.SCENARIO), digits=9).orderBy("month").collect()
    for r, (month, h, effective, leavers) in zip(got, plain_projection(*scenario[1:], 12), strict=True):
        assert r.month == month and abs(r.headcount - h) < 1e-6 and abs(r.effective_capacity - effective) < 1e-6 and abs(r.leavers - leavers) < 1e-6


def test_hires_required_is_the_smallest(spark):
    rows = [("a", 100, 0.02, 130), ("b", 50, 0.0, 50), ("c", 10, 0.5, 25), ("d", 100, 0.99, 300)]
    got = {r.name: r.hires for r in planning.hires_required(spark.createDataFrame(rows, "name string, headcount long, attrition double, target long")).collect()}
    for name, h, a, target in rows:
        want = next((n for n in range(target + h + 1) if round(plain_projection(h, a, n, 0, 0, 12)[-1][1], 3) >= target), None)
        assert got[name] == want


def test_skills(spark):
    aliases = spark.createDataFrame([("py", "python"), ("python", "python"), ("sql", "sql")], "alias string, skill string")
    evidence = spark.createDataFrame([("s", "Python, py and SQL."), ("s", "python"), ("t", "none")], "subject string, text string")
    years = spark.createDataFrame([("s", "python", 6.0)], "subject string, skill string, years double")
    held = planning.skill_holdings(evidence, aliases, years)
    assert {r.skill: (r.mentions, r.level) for r in held.collect()} == {"python": (3, 4), "sql": (1, 1)}
    needs = spark.createDataFrame([("dev", "tech", "python", 3), ("dev", "tech", "sql", 2), ("cook", "food", "knife", 1)], "role string, family string, skill string, required int")
    families = spark.createDataFrame([("python", "tech"), ("sql", "tech")], "skill string, family string")
    m = planning.match_roles(held, needs, families).first()
    assert (m.role, m.score, m.ready_now, m.stretch, m.missing) == ("dev", 0.85, False, True, ["sql: 1 to 2"])
    assert planning.gap_forecast(held, spark.createDataFrame([("python", 3, 2), ("knife", 1, 1)], "skill string, required int, demand long"), 0.5).where("skill = 'python'").first().supply == 0
    assert planning.duplicate_aliases(aliases.union(spark.createDataFrame([("PY", "other")], "a string, b string"))).count() == 1
    with pytest.raises(Exception, match="unknown skill"):
        planning.with_family(held, families.limit(1)).collect()


# Ledger


def entries(spark, n=12):
    rows = [(f"t{k % 2}", "w", "r", "s", "act", "sub", "ag", "ALLOW", ["a", "b"] if k % 3 else [], "ann" if k % 4 == 0 else None, at(k * 1.5), k) for k in range(n)]
    return spark.createDataFrame(rows, "tenant_id string, workflow string, run_id string, step string, action_type string, subject_id string, agent string, outcome string, reasons array<string>, approver string, recorded_at timestamp, write_seq long")


def test_ledger_finds_tampering(spark):
    key = b"secret"
    book = ledger.append(entries(spark), key=key).cache()
    assert all(r.intact and r.entries_checked == 6 and r.signed == 6 for r in ledger.verify(book, key).collect())
    broken = lambda df, k=key: {r.tenant_id: (r.broken_at, r.reason) for r in ledger.verify(df, k).where("NOT intact").collect()}
    third = (F.col("tenant_id") == "t0") & (F.col("sequence") == 2)
    assert broken(book.withColumn("outcome", F.when(third, "DENY").otherwise(F.col("outcome")))) == {"t0": (2, "content differs from its hash")}
    assert broken(book.where(~third)) == {"t0": (3, "sequence gap")}
    assert broken(book.withColumn("reasons", F.when(F.col("sequence") == 1, F.array(F.lit("ab"))).otherwise(F.col("reasons"))))
    assert broken(book.withColumn("signature", F.when(third, F.lit(None)).otherwise(F.col("signature")))) == {"t0": (2, "unsigned entry")}
    assert set(r for _, r in broken(book, b"other").values()) == {"signature does not verify"}
    rehashed = book.withColumn("previous_hash", F.when(third, F.lit("f" * 64)).otherwise(F.col("previous_hash")))
    assert broken(rehashed) == {"t0": (2, "broken link")}
    more = ledger.append(entries(spark, 4), ledger.heads(book), key)
    assert ledger.verify(book.union(more), key).where("intact").agg(F.sum("entries_checked")).first()[0] == 16
    unsigned = ledger.append(entries(spark))
    assert ledger.verify(ledger.sign_unsigned(unsigned, key), key, True).where("NOT intact").count() == 0


def test_evidence(spark, tmp_path):
    from kelpforge.sources import files

    key = b"secret"
    book = ledger.append(entries(spark), key=key).where("tenant_id = 't0'")
    files.write_evidence(book, ledger.evidence_manifest(book, "t0", key), str(tmp_path / "e"))
    manifest, back = files.read_evidence(spark, str(tmp_path / "e"), ledger.ENTRY)
    assert ledger.verify_evidence(back, manifest, key) == []
    assert ledger.verify_evidence(back.where("sequence <> 3"), manifest, key)
    assert ledger.verify_evidence(back, manifest, b"wrong") and ledger.verify_evidence(back, manifest, key, "0" * 64)
    with pytest.raises(ValueError):
        files.write_evidence(book, ledger.evidence_manifest(book, "t0"), str(tmp_path / "f"), cap=2)


# Governance and tables


def test_a_chain_is_worked_out_once_and_evidence_has_no_cap_of_its_own(spark, tmp_path):
    import inspect

    from kelpforge.sources import files

    assert inspect.signature(files.write_evidence).parameters["cap"].default is None
    turns = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            turns.add(len(part))
            yield part

    at = dt.datetime(2024, 1, 1, 0, 0, 0, 250)
    rows = [("t0", "w", "r", "s", "a", "é", "x", None, ["p", "qq"] if k % 2 else None, None, at, k) for k in range(6)]
    names = "tenant_id string, workflow string, run_id string, step string, action_type string, subject_id string, agent string, outcome string, reasons array<string>, approver string, recorded_at timestamp, write_seq long"
    entries = spark.createDataFrame(rows, names).mapInPandas(counted, names)
    book = ledger.append(entries, key=b"k")
    told = ledger.verify(book, b"k", True).collect()
    assert [(r.tenant_id, r.intact, r.entries_checked, r.signed) for r in told] == [("t0", True, 6, 6)]
    assert turns.value == 6  # the verification reads the chain several times, and nothing before it again
    assert [r.reasons for r in book.orderBy("sequence").collect()][:2] == [[], ["p", "qq"]]
    files.write_evidence(book, ledger.evidence_manifest(book, "t0", b"k"), str(tmp_path / "e"))
    manifest, back = files.read_evidence(spark, str(tmp_path / "e"), ledger.ENTRY)
    assert ledger.verify_evidence(back, manifest, b"k") == []  # microseconds are part of what is hashed


def test_gate(spark):
    actions = spark.createDataFrame(
        [(1, "t", "t", "read", [], False, 0.9), (2, "x", "t", "read", [], False, 0.9), (3, "t", "t", "fire", [], False, 0.9), (4, "t", "t", "read", ["pay"], False, 0.9), (5, "t", "t", "hire", [], True, 0.1), (6, "t", "t", "read", None, False, None)],
        "action_id int, tenant_id string, policy_tenant string, action_type string, domains array<string>, irreversible boolean, confidence double",
    )
    policy = spark.createDataFrame([("t", ["read"], ["fire"], ["health"], 0.5, "boss")], "tenant_id string, autonomous array<string>, forbidden array<string>, readable array<string>, floor double, approver_role string")
    got = {r.action_id: r for r in governance.gate(actions, policy, {"hire": "health"}).collect()}
    assert [got[k].verdict for k in range(1, 7)] == ["ALLOW", "DENY", "DENY", "DENY", "REQUIRE_HUMAN_APPROVAL", "ALLOW"]
    assert len(got[5].reasons) == 3 and got[5].approver_role == "boss" and "pay" in got[4].reasons[0]
    with pytest.raises(ValueError):
        governance.TenantPolicy("t", ["a"], ["a"], [])


def test_workflows(spark):
    steps = spark.createDataFrame(
        [("r", "a", "COMPLETED", [], False), ("r", "b", "PENDING", ["a"], False), ("r", "c", "PENDING", ["b"], False), ("s", "a", "SKIPPED", [], True), ("s", "b", "PENDING", ["a"], False), ("f", "a", "FAILED", [], False), ("f", "b", "AWAITING_APPROVAL", [], False)],
        "run_id string, step string, status string, requires array<string>, optional boolean",
    )
    assert {(r.run_id, r.step) for r in governance.runnable_steps(steps).collect()} == {("r", "b"), ("s", "b")}
    assert {r.run_id: r.status for r in governance.run_status(steps).collect()} == {"r": "RUNNING", "s": "RUNNING", "f": "FAILED"}
    definition = spark.createDataFrame(governance.WORKFLOWS, governance.WORKFLOW_COLUMNS)
    assert governance.definition_faults(definition).count() == 0
    assert {r["workflow"]: r["keys"] for r in governance.required_context(definition).collect()}["screening"] == ["record", "requirement"]
    events = spark.createDataFrame([(1, "screening", k, *e) for k, e in enumerate([("start", None, None), ("succeed", "collect", None), ("fail", "score", None), ("retry", "score", None), ("succeed", "score", None), ("approve", "decide", "ann")])], "run_id long, workflow string, seq int, kind string, step string, actor string")
    got = {r.step: (r.status, r.attempts, r.approver) for r in governance.fold_runs(definition, events).collect()}
    assert got == {"collect": ("COMPLETED", 1, None), "score": ("COMPLETED", 2, None), "decide": ("RUNNING", 1, "ann")}


def test_registry(spark):
    rows = [("m", 1, 1, "DRAFT"), ("m", 1, 2, "SHADOW"), ("m", 1, 3, "CANARY"), ("m", 1, 4, "LIVE"), ("m", 2, 5, "DRAFT"), ("m", 2, 6, "SHADOW"), ("m", 2, 7, "CANARY"), ("m", 2, 8, "LIVE"), ("m", 3, 9, "DRAFT"), ("m", 3, 10, "LIVE")]
    events = spark.createDataFrame([(*r, "ann", "") for r in rows], "name string, version int, seq int, stage string, actor string, reason string")
    assert [r.version for r in governance.illegal_transitions(events).collect()] == [3]
    assert {r.version: r.stage for r in governance.current_stages(events.where("version < 3")).collect()} == {1: "ARCHIVED", 2: "LIVE"}
    assert governance.register(events, "m", "bob").where("actor = 'bob'").first().version == 4


def test_tables(spark):
    df = spark.createDataFrame([(k, "t1" if k % 2 else "t2", f"Name_{k}%") for k in range(20)], "id int, tenant_id string, name string")
    assert tables.of_tenant(df, "t1").count() == 10 and df.where(tables.contains_any(["name"], "%NAME1_")).count() == 0 and df.where(tables.contains_any(["name"], "%%")).count() == 20
    p = tables.page(df, [F.col("id")], 5, 18).collect()
    assert [(r.id, r.total) for r in p] == [(18, 20), (19, 20)] and [r.id for r in tables.keyset_page(df, "id", 16, 10).collect()] == [17, 18, 19]
    slots = spark.createDataFrame([(1, "a", at(0), at(3600)), (2, "a", at(3600), at(7200)), (3, "a", at(1800), at(9000)), (4, "b", at(0), at(9000))], "n int, who string, s timestamp, e timestamp")
    pairs = {(r[0], r[1]) for r in tables.overlapping(slots, slots, "who", "s", "e").select("a.n", "b.n").where("a.n < b.n").collect()}
    assert pairs == {(1, 3), (2, 3)}
    filled = tables.backfill(spark.createDataFrame([(1, None), (2, "x")], "id int, key_id string"), "key_id", "id").orderBy("id").collect()
    assert len(filled[0].key_id) == 36 and filled[1].key_id == "x"
    assert spark.range(1).select(tables.clean_roles(F.array(F.lit(" admin"), F.lit("USER"), F.lit("user")), ["ADMIN", "USER"])).first()[0] == ["ADMIN", "USER"]


def test_state_store(spark, tmp_path):
    from kelpforge.sources import files

    store = files.StateStore(spark, str(tmp_path / "s"))
    store.put("kv", "a", {"x": 1})
    store.put("kv", "a", {"x": 2})
    assert store.get("kv", "a") == {"x": 2} and store.get("kv", "b", 7) == 7
    store.put("meta", "version", 99)
    with pytest.raises(ValueError):
        files.StateStore(spark, str(tmp_path / "s"))
    good, bad = files.parse_checked(spark.createDataFrame([('{"p": 0.5}',), ('{"p": 3}',), ("x",)], "j string"), "j", "p double", {"p in range": F.col("body.p").between(0, 1)})
    assert good.count() == 1 and bad.count() == 2
    files.write_csv(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().a == "'=1"


def test_models(spark):
    from kelpforge.operators import models
    from kelpforge.sources import files

    people = files.synthetic_employees(spark, 400)
    rows = planning.attrition_features(people).join(people.select("subject_key", "left"), "subject_key")
    names = ["engagement_score", "overtime_hours_monthly", "compensation_ratio_to_band", "tenure_years"]
    model = models.train(rows, names, "left", "logistic_regression")
    scored = models.score(model, rows, names)
    assert statistics.roc_auc(scored, "probability", "left").first().auc > 0.7
    weight = models.importance(model, names)
    assert abs(sum(weight.values()) - 1) < 1e-9 and weight["engagement_score"] > weight["tenure_years"]
    report = models.assess(model, rows, names, "subject_key", rows).first()
    assert report.gate == "PASS" and models.assess(model, rows, names, "subject_key", rows, "ADVERSE_IMPACT").first().gate == "WARN"
    with pytest.raises(ValueError):
        models.train(rows.limit(10), names, "left")
    trees = {"feature": np.array([[0, -1, -1]]), "threshold": np.array([[0.5, 0, 0]]), "left": np.array([[1, 0, 0]]), "right": np.array([[2, 0, 0]]), "value": np.array([[0, -1.0, 1.0]])}
    got = spark.createDataFrame([(0.5,), (0.6,)], "x double").select(models.score_trees(trees, 0.0, 1.0, [F.col("x")]).alias("p")).collect()
    assert [round(r.p, 6) for r in got] == [round(1 / (1 + math.exp(1)), 6), round(1 / (1 + math.exp(-1)), 6)]
    assert (models.load_arrays(models.save_arrays(trees), ["feature"])["value"] == trees["value"]).all()


def test_streams_late_credit(spark, tmp_path):
    from kelpforge.streaming import streams

    spark.createDataFrame([(k, at(k)) for k in range(5)], "request_id long, shown_at timestamp").write.parquet(str(tmp_path / "i"))
    spark.createDataFrame([(1, at(60)), (1, at(70)), (2, at(9000))], "request_id long, clicked_at timestamp").write.parquet(str(tmp_path / "c"))
    i = spark.readStream.schema("request_id long, shown_at timestamp").parquet(str(tmp_path / "i"))
    c = spark.readStream.schema("request_id long, clicked_at timestamp").parquet(str(tmp_path / "c"))
    got = streams.drain(streams.late_credit(i, c)).collect()
    assert [r.request_id for r in got if r.credited] == [1]

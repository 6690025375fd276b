"""Smaller functions: what they return, and odd rows."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforge.functions import hashing, numeric, text
from kelpforge.operators import features, governance, models, planning, privacy, ranking, retrieval, sentiment, statistics, tables
from kelpforge.sources import files
from kelpforge.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_numeric(spark):
    row = one(
        spark, numeric.python_round(F.lit(2.5), 0), numeric.python_round(F.lit(3.5), 0), numeric.half_life_decay(F.lit(-5), 10.0), numeric.half_life_decay(F.lit(10), 10.0), numeric.fresh_score(F.lit(2.0), F.lit(None).cast("double"), 10.0, 0.5),
        numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), numeric.cosine(F.lit(None).cast("array<double>"), F.array(F.lit(1.0))), numeric.platt(F.lit(0.3), 1.0, 0.0), numeric.risk_band(F.lit(None).cast("double")), numeric.proficiency(F.lit(0), F.lit(9)),
    )
    assert tuple(row)[:7] == (2.0, 4.0, 1.0, 0.5, 2.0, 0.0, 0.0) and abs(row[7] - 0.3) < 1e-12 and row[8] is None and row[9] == 0
    assert one(spark, numeric.normalised(F.array(F.lit(3.0), F.lit(4.0))))[0] == [0.6, 0.8] and one(spark, numeric.normalised(F.array(F.lit(0.0))))[0] == [0.0]


def test_hashing(spark):
    row = one(spark, hashing.parse_iso(F.lit("2024-01-01T00:00:00")), hashing.parse_iso(F.lit("2024-01-01T02:00:00+02:00")), hashing.parse_iso(F.lit("never")), hashing.sha256_hex(F.lit("k")))
    assert row[0] == row[1] and row[2] is None and row[3] == hashlib.sha256(b"k").hexdigest()


def test_training_rows_and_vectors(spark):
    labels = spark.createDataFrame([("u", "i", 1), ("u", "zz", 0)], "user_id string, item_id string, label int")
    users, items = spark.createDataFrame([("u", 1.0)], "user_id string, a double"), spark.createDataFrame([("i", 2.0)], "item_id string, b double")
    uv, iv = spark.createDataFrame([("u", [1.0, 2.0])], "user_id string, vector array<double>"), spark.createDataFrame([("i", [3.0, 4.0])], "item_id string, vector array<double>")
    got = {r.item_id: r for r in features.assemble_training_rows(labels, users, items, uv, iv).collect()}
    assert got["i"].retrieval_score == 11.0 and got["zz"].retrieval_score == 0.0 and got["zz"].b is None
    z = retrieval.vectors_or_zero(spark.createDataFrame([("q",)], "item_id string"), iv.select("item_id", F.col("vector").cast("array<float>").alias("vector")), "item_id", 2).first()
    assert z.vector == [0.0, 0.0]


def test_governance_parts(spark):
    assert governance.conservative("t").autonomous == () and governance.permissive("t", ["a", "b"], "b").autonomous == ("a",)
    steps = spark.createDataFrame([(1, "screening", "score", "AWAITING_APPROVAL"), (1, "screening", "odd", "PENDING"), (1, "screening", "collect", "COMPLETED")], "run_id long, workflow string, step string, status string")
    assert governance.pending_approvals(steps).first().step == "score"
    definition = spark.createDataFrame(governance.WORKFLOWS, governance.WORKFLOW_COLUMNS)
    runs = governance.rebuild_runs(spark.createDataFrame([(1,), (2,)], "run_id long"), steps, definition).orderBy("run_id").collect()
    assert [s.step for s in runs[0].steps] == ["collect", "score"] and runs[1].steps is None
    bad = definition.union(spark.createDataFrame([("mobility", 5, "late", ["later"], False, False, []), ("mobility", 6, "match", [], False, False, [])], governance.WORKFLOW_COLUMNS))
    assert {r.fault for r in governance.definition_faults(bad).collect()} == {"defined twice", "needs later earlier"}
    amend = spark.createDataFrame([(1, {"a": "x", "b": " ", "c": "y"})], "run_id long, values map<string,string>")
    assert sorted(r.key for r in governance.amendment_faults(amend, ["a", "b"]).collect()) == ["b", "c"]
    assert governance.escalation(spark.createDataFrame([(1,)], "action_id long"), "late", "lead").first().verdict == "ESCALATE"
    versions = spark.createDataFrame([(1, "PASS", True), (2, "BLOCK", True), (3, "PASS", False)], "version int, gate string, signature_valid boolean")
    assert governance.previous_eligible(versions, 4).first().version == 1
    stages = spark.createDataFrame([("m", 3, "LIVE"), ("m", 2, "LIVE")], "name string, version int, stage string")
    assert governance.by_stage(stages, "m", "LIVE").first().version == 2


def test_text_and_sentiment_parts(spark):
    report = spark.createDataFrame([("g", False, 0.5, "pay", -0.5), ("g", False, 0.5, "lead", 0.2), ("h", False, -0.2, "pay", -0.9), ("k", True, None, None, None)], "grp string, suppressed boolean, overall double, aspect string, score double")
    assert [(r.grp, r.aspect) for r in sentiment.concerns(report).collect()] == [("g", "pay"), ("h", "pay")]
    assert tuple(sentiment.extremes(report).first()) == ("h", "g")
    assert one(spark, text.normalise(F.lit("  A \n\u00a0b Stra\u00dfe"), "case"))[0] == "a b strasse"
    assert one(spark, text.normalise(F.lit(" A "), ""))[0] == " A " and one(spark, text.normalise(F.lit(None).cast("string"), "json case"))[0] is None
    assert one(spark, text.scrub(F.lit("j\u00f6rg@x.de or +49 (30) 1234-567, not 12345678")))[0] == "[email] or [phone], not 12345678"
    told = privacy.Policy("sixteen-byte-salt", 2024)
    for column in ("sex", "race", "first_name", "last_name", "passport_number"):
        with pytest.raises(ValueError):
            privacy.assert_clean([column], told)
    df = spark.createDataFrame([("mail a@b.org", "x")], "summary string, notes string")
    assert privacy.scrub_changes(df, ["summary", "notes"]).first().asDict() == {"summary": True, "notes": False}
    with pytest.raises(ValueError):
        privacy.assert_no_protected(["Gender", "x"], ["gender"])


def test_planning_parts(spark):
    gaps = spark.createDataFrame([("a", 3), ("b", 5)], "skill string, shortfall long")
    assert planning.gap_summary(gaps).first().summary == "8 positions short, most in b"
    sums = {r.name: r for r in planning.scenario_comparison([("fine", 100, 0.0, 0, 0, 50.0), ("short", 10, 0.1, 0, 0, 20.0)], spark, 3).collect()}
    assert sums["fine"].first_shortfall_month is None and sums["short"].first_shortfall_month == 1 and "short from month 1" in sums["short"].summary
    matches = spark.createDataFrame([("s", "r1", 0.9, False), ("s", "r2", 0.6, True), ("s", "r3", 0.4, True), ("t", "r1", 0.95, True)], "subject string, role string, score double, ready_now boolean")
    assert [r.role for r in planning.ranked_roles(matches).where("subject = 's'").orderBy("rank").collect()] == ["r2", "r1"]
    assert [r.subject for r in planning.ranked_candidates(matches).where("role = 'r1'").orderBy("rank").collect()] == ["t", "s"]


def test_files_parts(spark, tmp_path):
    store = files.StateStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, x int")
    store.append("a", rows)
    (path,) = store.purge(["a"], "t1", 1)
    assert [r.x for r in spark.read.parquet(path).collect()] == [2] and store.read("a").count() == 2
    built = []
    for _ in range(2):
        assert store.restore_or_build("f" * 20, lambda: built.append(1) or rows).count() == 2
    assert built == [1]
    (tmp_path / "model.bin").write_bytes(b"abc")
    assert files.read_artifact(spark, str(tmp_path / "model.bin"), hashlib.sha256(b"abc").hexdigest()) == b"abc"
    with pytest.raises(ValueError):
        files.read_artifact(spark, str(tmp_path / "model.bin"), "0")
    (tmp_path / "r.json").write_text('{\n "hit": 0.5\n}')
    assert files.read_result(spark, str(tmp_path / "r.json")).first().hit == 0.5
    assert files.as_document(rows, "x").first().document == '[{"x":1,"tenant_id":"t1"},{"x":2,"tenant_id":"t2"}]'
    (tmp_path / "r.csv").write_text("user,item,rating,timestamp\n1,2,4.5,99\n")
    assert tuple(files.read_ratings(spark, str(tmp_path / "r.csv")).first()) == (1, 2, 4.5, 99)


def test_tables_parts(spark):
    keys = spark.createDataFrame([("k1", ["admin"], True), ("k2", ["ADMIN"], False), ("k3", ["user"], True)], "key_id string, roles array<string>, active boolean")
    assert tables.removes_last_admin(keys, "k1").first().last and not tables.removes_last_admin(keys, "k3").first().last
    booked = spark.createDataFrame([("e", T0, T0, ["a", "b"])], "event_ref string, starts_at timestamp, ends_at timestamp, attendees array<string>")
    assert {r.attendee for r in tables.slots_of(booked).collect()} == {"a", "b"}
    alerts = spark.createDataFrame([("x", 1, "raise"), ("x", 2, "raise"), ("x", 3, "clear"), ("x", 4, "raise"), (None, 5, "raise"), (None, 6, "raise")], "dedupe_key string, seq int, kind string")
    assert sorted(r.seq for r in tables.unsuppressed_alerts(alerts).collect()) == [1, 4, 5, 6]
    with pytest.raises(ValueError):
        tables.of_tenant(keys, "")
    with pytest.raises(Exception, match="unknown roles"):
        spark.range(1).select(tables.clean_roles(F.array(F.lit("root")), ["ADMIN"])).collect()
    counts = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "arm string, n double")
    assert statistics.arm_counts(counts, "arm", F.col("n") > 2).first().successes == 1


def test_ranking_parts(spark):
    m = spark.createDataFrame([("q", 0.5), ("q", 0.5), ("q", 7.0)], "q string, p double")
    assert ranking.any_click_probability(m, "q", "p").first().p_any == 1.0
    c = spark.createDataFrame([(1, "f1", 1, 0.9)], "a int, b string, c int, d double")
    assert ranking.ranked(c, "b", "d", "a").first()["rank"] == 1
    assert models.model_card("m", 1, {"b": 2.0, "a": 1.0}, ["x"])["metrics"] == {"a": 1.0, "b": 2.0}
    best, scored = models.grid_search(lambda k: k, lambda k: -abs(k - 2), [{"k": 1}, {"k": 2}, {"k": 3}])
    assert best == {"k": 2} and len(scored) == 3
    train, held = models.calibration_split(spark.range(4000), "id")
    assert abs(held.count() / 4000 - 0.25) < 0.03 and train.count() + held.count() == 4000
    flat = spark.createDataFrame([(0.4, 1), (0.6, 1)], "p double, y int")
    assert models.fit_platt(flat, "p", "y") == (1.0, 0.0)
    with pytest.raises(ValueError):
        models.load_arrays(models.save_arrays({"a": np.zeros(2)}), ["b"])
    with pytest.raises(ValueError):
        models.estimator("oracle")


def test_streams_outbox(spark, tmp_path):
    write = streams.to_outbox(str(tmp_path / "o"), b"key")
    write(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "alert_id long, payload string"), 7)
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == 2 and len(got.first().signature) == 64
    w = spark.createDataFrame([("live", 1), ("canary", 2)], "window string, n int")
    assert statistics.worst_severity(spark.createDataFrame([("f", "STABLE"), ("g", "MODERATE")], "feature string, severity string")).first().worst == "MODERATE"
    assert streams.current_epoch(w.withColumnRenamed("n", "seq"), spark.createDataFrame([(1,)], "seq int")).count() == 1

"""The guard by spans against the guard that counts a name's outcomes in one task."""

import random

import pytest

from kelpforge.streaming import guard, streams

OUTCOME = "name string, arm string, version int, seq long, request_id string, clicked boolean, probability double, latency_ms double, is_credit boolean"


def outcomes(seed, n, names="ab"):
    """Three batches; versions rise now and then, some rows are of old versions, some latencies are missing, some clicks come late."""
    rng, rows = random.Random(seed), []
    for name in names:
        version, shown = 1, []
        for k in range(n):
            version += rng.random() < 4 / n
            arm = rng.choice(["live", "canary"])
            own = version - (rng.random() < 0.05)
            if shown and rng.random() < 0.15:
                arm, own, request = rng.choice(shown[-60:])
                rows.append((name, arm, own, k, request, None, None, None, True))
                continue
            request = f"{rng.randrange(n)}"
            shown.append((arm, own, request))
            good = rng.random() < (0.3 if arm == "live" or version % 2 else 0.22)
            rows.append((name, arm, own, k, request, good, rng.choice([0.3, 0.3, 0.2, 0.5]), rng.choice([None, float("nan"), 20.0, 30.0 + version, 90.0]), False))
    return rows


@pytest.mark.parametrize("seed,limits", [(2, {"advance_after": 75}), (3, {"least_ctr": 0.0, "most_error": 0.9})])
def test_spans_tell_what_one_task_tells(spark, tmp_path, seed, limits):
    limits = guard.GuardLimits(**({"minimum": 50, "every": 10, "keep": 40, "latencies": 15} | limits))
    rows = outcomes(seed, 600)
    for begun in (0, 300):
        spark.createDataFrame([r for r in rows if begun <= r[3] < begun + 300], OUTCOME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = streams.drain(guard.guard(stream(), limits)).orderBy("name", "seq").collect()
    got = guard.drained(stream(), limits, span_rows=110).orderBy("name", "seq").collect()
    assert len(want) > 10 and got == want


def test_a_span_replays_its_own_outcomes_and_few_before(spark, monkeypatch):
    """All outcomes of one name went through one task."""
    rows = [("m", "canary" if k % 2 else "live", 1, k, str(k), k % 3 == 0, 0.33, 20.0, False) for k in range(20_000)]
    batch, held = spark.createDataFrame(rows, OUTCOME), spark.createDataFrame([], guard.HELD)
    seen = spark.sparkContext.accumulator(0)
    whole, most = guard._span, 9_000

    def counted(limits):
        replay = whole(limits)

        def small(key, rows):
            assert len(rows) < most
            seen.add(1)
            return replay(key, rows)

        return small

    monkeypatch.setattr(guard, "_span", counted)
    told, after = guard.judged(batch, held, guard.GuardLimits(keep=100, latencies=50), span_rows=2_000)
    assert told.count() == 400 and seen.value > 5
    assert [(r["live_impressions"], r["canary_impressions"], len(r["canary_ids"])) for r in after.collect()] == [(10_000, 10_000, 100)]


def test_what_is_counted_after_an_end_is_held_for_the_next_canary(spark, tmp_path):
    """Version 1 is stopped in the first span, the rest of the batch is only counted; late clicks and version 2 come in the next batch."""
    rng, limits = random.Random(8), guard.GuardLimits(minimum=20, every=10, keep=30, latencies=15)
    row = lambda k, version: ("m", "canary" if k % 2 else "live", version, k, str(k), rng.random() < (0.02 if k % 2 and version == 1 else 0.4), 0.4, 20.0, False)
    late = [("m", "live", 1, 400 + j, str(398 - 2 * j), None, None, None, True) for j in range(40)]
    for rows in ([row(k, 1) for k in range(400)], [*late, *(row(k, 2) for k in range(440, 640))]):
        spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = streams.drain(guard.guard(stream(), limits)).orderBy("seq").collect()
    got = guard.drained(stream(), limits, span_rows=150).orderBy("seq").collect()
    assert {r["version"] for r in want} == {1, 2} and got == want

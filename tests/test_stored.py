"""Stored ledgers with several writers, and alerts that survive restarts."""

import collections
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kelpforge.operators import ledger, stored_ledger
from kelpforge.operators.stored_ledger import Contention, StoredLedger
from kelpforge.streaming import alerts
from kelpforge.streaming.alerts import AlertBook

COLUMNS = "tenant_id string, workflow string, run_id string, step string, action_type string, subject_id string, agent string, outcome string, reasons array<string>, approver string, recorded_at timestamp, write_seq long"
NOON = datetime(2024, 1, 1, 12)


def entries(spark, writer, n, tenants):
    rows = [(tenants[k % len(tenants)], "w", f"{writer}-{k}", "s", "a", "subj", "agent", "ALLOW", ["r"], None, NOON + timedelta(seconds=k), k) for k in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def test_appending_in_turn_gives_one_chain(spark, tmp_path):
    book = StoredLedger(spark, str(tmp_path / "book"), key=b"key", groups=3)
    assert book.read().count() == 0 and book.append(entries(spark, "none", 0, ["t"])) == 0
    for k in range(3):
        assert book.append(entries(spark, f"w{k}", 10, ["a", "b", "c"])) == 0
    whole = StoredLedger(spark, book.folder, key=b"key", groups=3)
    assert {(r["tenant_id"], r["intact"], r["entries_checked"], r["unsigned"]) for r in whole.verify(True).collect()} == {("a", True, 12, 0), ("b", True, 9, 0), ("c", True, 9, 0)}
    assert {r["tenant_id"]: r["sequence"] for r in whole.heads().collect()} == {"a": 11, "b": 8, "c": 8}
    order = [r["run_id"] for r in whole.read().where("tenant_id = 'a'").orderBy("sequence").collect()]
    assert order == [f"w{k}-{j}" for k in range(3) for j in (0, 3, 6, 9)]


def test_two_writers_at_once_leave_one_unforked_chain(spark, tmp_path):
    folder, failed = str(tmp_path / "book"), []

    def write(name):
        book = StoredLedger(spark, folder, groups=2)
        for k in range(2):
            try:
                book.append(entries(spark, f"{name}{k}", 8, ["t", "u"]))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    threads = [threading.Thread(target=write, args=(name,)) for name in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    book = StoredLedger(spark, folder, groups=2)
    assert not failed and all(r["intact"] and r["entries_checked"] == 16 for r in book.verify().collect())
    runs = collections.Counter(r["run_id"] for r in book.read().collect())
    assert set(runs.values()) == {1} and len(runs) == 32
    times = book.read().groupBy("tenant_id").agg(F.countDistinct("sequence").alias("n"), F.max("sequence").alias("last")).collect()
    assert all(r["n"] == 16 and r["last"] == 15 for r in times)


def test_a_late_writer_chains_again_and_gives_up_in_the_end(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "book")
    real, other = stored_ledger.create_once, StoredLedger(spark, folder, groups=1)

    def beaten(times):
        left = [times]

        def create(session, path, body=""):
            if left[0] and "/log/" in path:
                left[0] -= 1
                with monkeypatch.context() as m:
                    m.setattr(stored_ledger, "create_once", real)
                    other.append(entries(spark, f"first{left[0]}", 2, ["t"]))
            return real(session, path, body)

        return create

    book = StoredLedger(spark, folder, groups=1)
    monkeypatch.setattr(stored_ledger, "create_once", beaten(2))
    assert book.append(entries(spark, "late", 3, ["t"])) == 2
    monkeypatch.setattr(stored_ledger, "RETRIES", 1)
    monkeypatch.setattr(stored_ledger, "create_once", beaten(2))
    with pytest.raises(Contention):
        book.append(entries(spark, "never", 3, ["t"]))
    told = other.verify().first()
    assert told["intact"] and told["entries_checked"] == 2 * 4 + 3
    assert not {r["run_id"] for r in other.read().collect()} & {"never-0"}


def test_a_chain_over_many_batches_of_one_task(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        book = ledger.append(entries(spark, "w", 60, ["a", None, "b"]))
        told = {r["tenant_id"]: (r["intact"], r["entries_checked"]) for r in ledger.verify(book.where("tenant_id IS NOT NULL")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert told == {"a": (True, 20), "b": (True, 20)}


# Alerts


def found(spark, *keys):
    return spark.createDataFrame([(k, "drift", f"{k} drifted", alerts.payload_of(key=k)) for k in keys], "key string, kind string, message string, payload string")


def test_alerts_are_raised_and_cleared_once(spark, tmp_path):
    book = AlertBook(spark, str(tmp_path / "alerts"))
    for number, keys in enumerate((["a"], ["a", "b", "b"], ["b"], ["a", "b"])):
        book.tick(found(spark, *keys), number, NOON)
    told = sorted((r["number"], r["key"], r["event"]) for r in book.events().collect())
    assert told == [(0, "a", "raised"), (1, "b", "raised"), (2, "a", "cleared"), (3, "a", "raised")]
    assert {r["alert_id"] for r in book.open_alerts().collect()} == {"a#3", "b#1"}


def test_five_tries_with_doubling_waits(spark, tmp_path):
    book = AlertBook(spark, str(tmp_path / "alerts"))
    book.tick(found(spark, "a", "b"), 0, NOON)
    at, tried = NOON, []
    refuse = lambda m: None if m["alert_id"].startswith("b") and m["signature"] else "unreachable"
    for wait in (0, 59, 1, 119, 1, 240, 480, 960, 99999):
        at += timedelta(seconds=wait)
        tried.append((book.pending(at).count(), book.deliver(refuse, at, key=b"secret")))
    assert tried == [(2, 1), (0, 0), (1, 0), (0, 0), (1, 0), (1, 0), (1, 0), (0, 0), (0, 0)]
    told = {r["key"]: (r["tries"], r["delivered"], r["cleared"]) for r in book.states().collect()}
    assert told == {"a": (5, False, False), "b": (1, True, False)}


def test_a_restarted_stream_raises_nothing_twice(spark, tmp_path):
    """The run dies after the book has written a tick and before the stream has noted it; the batch comes again."""
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    book = AlertBook(spark, str(tmp_path / "alerts"))
    spark.createDataFrame([("a", 1), ("b", 0)], "key string, bad int").coalesce(1).write.parquet(source)
    holds = lambda batch: batch.where("bad = 1").select("key", F.lit("kind").alias("kind"), F.lit("m").alias("message"), F.lit("{}").alias("payload"))

    def run(dies):
        tick = book.watch(holds, lambda: NOON)

        def work(batch, number):
            tick(batch, number)
            if dies:
                raise RuntimeError("killed")

        query = spark.readStream.schema("key string, bad int").parquet(source).writeStream.foreachBatch(work).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run(True)
    sent = book.deliver(lambda m: None, NOON)
    run(False)
    spark.createDataFrame([("a", 1), ("c", 1)], "key string, bad int").coalesce(1).write.mode("append").parquet(source)
    run(False)
    raised = [r["key"] for r in book.events().where("event = 'raised'").collect()]
    assert sent == 1 and sorted(raised) == ["a", "c"]
    assert book.deliver(lambda m: None, NOON) == 1 and book.deliver(lambda m: None, NOON) == 0


def test_a_run_that_dies_after_sending_sends_again(spark, tmp_path, monkeypatch):
    book = AlertBook(spark, str(tmp_path / "alerts"))
    book.tick(found(spark, "a"), 0, NOON)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(AlertBook, "_write", dies)
        book.deliver(lambda m: None, NOON)
    assert AlertBook(spark, book.folder).deliver(lambda m: None, NOON) == 1

"""Alerts as a stored state machine: raised when a condition appears, cleared when it is gone, delivered with five tries.

    events/tick-<number>       what one tick found: alerts raised and cleared
    events/delivery-<number>   one row for each try of a delivery run
    numbers/<number>           taken numbers of delivery runs

An alert's state is the fold of its events, so nothing is held in the driver. A tick's events depend on the events before
it and on what it found, and replace what an earlier run of the same tick wrote: after a restart, a stream that goes
through its last batch again raises nothing twice. An alert is sent before its try is written, so a run that dies in
between sends it again, with the same alert_id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.functions.hashing import hmac_sha256
from kelpforge.sources.shared import create_once, names_in

TRIES, FIRST_WAIT_SECONDS = 5, 60
EVENT = "alert_id string, key string, kind string, message string, payload string, event string, at timestamp, number long, error string"


class AlertBook:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def events(self, before_tick: int | None = None) -> DataFrame:
        """All events; with before_tick those of earlier ticks only."""
        names = names_in(self.spark, f"{self.folder}/events")
        if before_tick is not None:
            names = [n for n in names if n.startswith("tick-") and int(n[5:]) < before_tick]
        # A folder without its success mark is of a run that failed, and counts for nothing.
        paths = [p for n in names if "_SUCCESS" in names_in(self.spark, p := f"{self.folder}/events/{n}")]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.select(*(c.split()[0] for c in EVENT.split(", "))).write.mode("overwrite").parquet(f"{self.folder}/events/{name}")

    def open_alerts(self, before_tick: int | None = None) -> DataFrame:
        """alert_id, key, kind of alerts that were raised and not cleared."""
        ticks = self.events(before_tick).where("event IN ('raised', 'cleared')")
        last = ticks.groupBy("key").agg(F.max_by(F.struct("alert_id", "kind", "event"), "number").alias("last"))
        return last.where("last.event = 'raised'").select("last.alert_id", "key", "last.kind")

    def tick(self, found: DataFrame, number: int, at: datetime) -> None:
        """found: key, kind, message, payload of what holds now; ticks are numbered upwards. Of a key's rows one counts."""
        now = found.groupBy("key").agg(F.min(F.struct("kind", "message", "payload")).alias("f")).select("key", "f.*")
        held = self.open_alerts(number)
        stamp = {"at": F.lit(at).cast("timestamp"), "number": F.lit(number).cast("long"), "error": F.lit(None).cast("string")}
        raised = now.join(held.select("key"), "key", "left_anti").withColumns({"alert_id": F.concat_ws("#", "key", F.lit(number)), "event": F.lit("raised"), **stamp})
        gone = held.join(now.select("key"), "key", "left_anti")
        cleared = gone.withColumns({"message": F.lit(None).cast("string"), "payload": F.lit(None).cast("string"), "event": F.lit("cleared"), **stamp})
        self._write(f"tick-{number}", raised.unionByName(cleared))

    def watch(self, compute: Callable[[DataFrame], DataFrame], clock: Callable[[], datetime] = datetime.now) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: compute tells what holds after a batch (key, kind, message, payload)."""
        return lambda batch, number: self.tick(compute(batch), number, clock())

    def states(self) -> DataFrame:
        """alert_id, key, kind, message, payload, raised_at, cleared, tries, tried_at, delivered: one row per alert."""
        of = lambda event, c: F.max(F.when(F.col("event") == event, F.col(c)))
        tried = F.col("event").isin("failed", "delivered")
        told = self.events().groupBy("alert_id").agg(
            *(of("raised", c).alias(c) for c in ("key", "kind", "message", "payload")), of("raised", "at").alias("raised_at"), F.max(F.col("event") == "cleared").alias("cleared"),
            F.count(F.when(tried, 1)).alias("tries"), F.max(F.when(tried, F.col("at"))).alias("tried_at"), F.max(F.col("event") == "delivered").alias("delivered"),
        )
        return told.where("key IS NOT NULL")

    def pending(self, at: datetime, first_wait: int = FIRST_WAIT_SECONDS) -> DataFrame:
        """Undelivered alerts with tries left whose wait is over, which doubles with each try. Cleared ones are told too: they did hold."""
        wait = F.lit(first_wait) * F.pow(F.lit(2), F.col("tries") - 1)
        due = F.col("tried_at").isNull() | (F.unix_micros(F.lit(at).cast("timestamp")) >= F.unix_micros("tried_at") + wait * 1_000_000)
        return self.states().where(~F.col("delivered") & (F.col("tries") < TRIES) & due)

    def deliver(self, send: Callable[[dict], str | None], at: datetime, key: bytes | None = None, first_wait: int = FIRST_WAIT_SECONDS) -> int:
        """Tries each pending alert once, in tasks; gives how many were delivered. send gets the message and gives an error or None.

        The message has alert_id, body and, with a key, signature: the HMAC-SHA256 of the body, for a header of the request.
        """
        due = self.pending(at, first_wait)
        body = F.to_json(F.struct("alert_id", "kind", "message", F.date_format("raised_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"), "payload"))
        due = due.withColumn("body", body).withColumn("signature", hmac_sha256(key, F.col("body")) if key else F.lit(None).cast("string"))

        def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                errors = [send({"alert_id": a, "body": b, "signature": s}) for a, b, s in zip(part["alert_id"], part["body"], part["signature"], strict=True)]
                yield pd.DataFrame({"alert_id": part["alert_id"], "key": part["key"], "kind": part["kind"], "error": pd.Series(errors, dtype=object)})

        number = len(names_in(self.spark, f"{self.folder}/numbers"))
        while not create_once(self.spark, f"{self.folder}/numbers/{number:012d}"):
            number += 1
        tried = due.select("alert_id", "key", "kind", "body", "signature").mapInPandas(sent, "alert_id string, key string, kind string, error string")
        text = F.lit(None).cast("string")
        rows = tried.withColumns({"message": text, "payload": text, "event": F.when(F.col("error").isNull(), "delivered").otherwise("failed"), "at": F.lit(at).cast("timestamp"), "number": F.lit(number).cast("long")})
        self._write(f"delivery-{number}", rows)
        return self.spark.read.parquet(f"{self.folder}/events/delivery-{number}").where("event = 'delivered'").count()


def payload_of(**values) -> str:
    return json.dumps(values, sort_keys=True)

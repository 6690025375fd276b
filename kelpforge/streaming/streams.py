"""Streaming forms: bounded windows, late credit, idempotent feedback, rate limits, periodic ticks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpforge.operators.statistics import matrix_values, psi_merge_first
from kelpforge.sources.shared import exists, scratch


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Parquet files of one table as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 8).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder; in update mode a row's later forms come after it."""
    path = scratch(stream.sparkSession, "stream")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # noqa: E731  a batch that comes again replaces itself
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-marks").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    held = stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path) if exists(stream.sparkSession, path) else held


def idempotent_feedback(feedback: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of each (request_id, item_id) within the watermark."""
    return feedback.withWatermark("at", delay).dropDuplicatesWithinWatermark(["request_id", "item_id"])


def late_credit(impressions: DataFrame, clicks: DataFrame, within: str = "1 hour") -> DataFrame:
    """Impressions (request_id, shown_at) with whether a click (request_id, clicked_at) came within the bound; each once, when it is settled.

    The bound is time; the count-based bound is in count_window.
    """
    i = impressions.withWatermark("shown_at", "10 minutes").alias("i")
    c = clicks.withWatermark("clicked_at", "10 minutes").dropDuplicatesWithinWatermark(["request_id"]).alias("c")
    meets = F.expr(f"i.request_id = c.request_id AND c.clicked_at >= i.shown_at AND c.clicked_at <= i.shown_at + INTERVAL {within}")
    return i.join(c, meets, "leftOuter").select("i.request_id", "i.shown_at", F.col("c.request_id").isNotNull().alias("credited"))


def count_window(outcomes: DataFrame, keep: int = 5000) -> DataFrame:
    """window, impressions, clicks after each batch, over the newest `keep` impressions of each window.

    outcomes: window, seq, request_id, clicked, is_credit. A credit turns an impression that is still in the window into
    a click, at most once; credits for others are dropped. `keep` bounds the state.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, clicked = (list(x) for x in state.get) if state.exists else ([], [])
        for e in pd.concat(list(parts)).sort_values("seq").itertuples():
            if e.is_credit:
                if e.request_id in ids:
                    clicked[ids.index(e.request_id)] = True
            else:
                ids.append(e.request_id)
                clicked.append(bool(e.clicked))
                ids, clicked = ids[-keep:], clicked[-keep:]
        state.update((ids, clicked))
        yield pd.DataFrame({"window": [key[0]], "impressions": [len(ids)], "clicks": [sum(clicked)]})

    return outcomes.groupBy("window").applyInPandasWithState(update, "window string, impressions long, clicks long", "ids array<long>, clicked array<boolean>", "update", GroupStateTimeout.NoTimeout)


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """key, seq, allowed of requests (key, seq, at): at most `limit` admitted ones in any `seconds`; refused ones don't count."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted = list(state.get[0]) if state.exists else []
        out = []
        for e in pd.concat(list(parts)).sort_values(["at", "seq"]).itertuples():
            now = e.at.timestamp()
            admitted = [t for t in admitted if t > now - seconds]
            fine = len(admitted) < limit
            if fine:
                admitted.append(now)
            out.append((key[0], e.seq, fine))
        state.update((admitted,))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed"])

    kind = dict(requests.dtypes)["key"]
    return requests.groupBy("key").applyInPandasWithState(update, f"key {kind}, seq long, allowed boolean", "admitted array<double>", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def current_epoch(rows: DataFrame, switches: DataFrame, order: str = "seq") -> DataFrame:
    """Rows after the last switch of mode: counters start again with each epoch."""
    last = switches.agg(F.max(order).alias("__last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col(order) > F.coalesce("__last", F.lit(-1))).drop("__last")


def to_outbox(path: str, key: bytes):
    """A foreachBatch function that appends alerts (alert_id, payload) with a signature; delivery reads the table, at least once."""
    from kelpforge.functions.hashing import hmac_sha256

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["alert_id"]).select("alert_id", "payload", hmac_sha256(key, F.col("payload")).alias("signature"), F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(path)

    return write


def scheduled_checks(
    ledger: DataFrame, reference: DataFrame, served: DataFrame, features: Sequence[str], trained_at: str, now: str, days: int = 30, least_rows: int = 200, retrain_days: int = 90
) -> DataFrame:
    """name, passed, detail: ledger integrity, drift of what was served against what the model was trained on, whether training is due.

    reference holds the training rows that were kept with the model, served the scored rows with the time `at`. Rows of the
    last `days` before now in which no feature is null are compared by PSI, if there are least_rows of them and a reference;
    a feature whose severity is SIGNIFICANT fails the check. Training is due after retrain_days, or with drift.
    """
    from kelpforge.operators.ledger import verify

    chains = verify(ledger).agg(F.sum((~F.col("intact")).cast("long")).alias("bad"))
    a = chains.select(F.lit("ledger").alias("name"), (F.coalesce("bad", F.lit(0)) == 0).alias("passed"), F.format_string("%d broken chains", F.coalesce("bad", F.lit(0))).alias("detail"))

    end = F.lit(now).cast("timestamp_ntz")
    recent = served.where((F.col("at") <= end) & (F.col("at") > end - F.expr(f"INTERVAL {days} DAYS"))).select(*features).dropna()
    values = matrix_values(reference.select(*features), features, F.lit(False)).union(matrix_values(recent, features, F.lit(True)))
    worst = psi_merge_first(values).where("severity = 'SIGNIFICANT'").agg(F.array_join(F.array_sort(F.collect_set("feature")), ", ").alias("drifted"))
    rows = recent.agg(F.count(F.lit(1)).alias("rows"))
    known = reference.agg(F.count(F.lit(1)).alias("known"))
    judged = rows.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(worst)).withColumn(  # three tables of one row
        "enough", (F.col("rows") >= least_rows) & (F.col("known") > 0)
    )
    judged = judged.withColumn("drifted", F.when(F.col("enough"), F.col("drifted")).otherwise(""))
    told = F.when(~F.col("enough"), F.format_string("%d rows are too few to tell", "rows")).when(F.col("drifted") == "", F.format_string("%d rows, no drift", "rows")).otherwise(F.format_string("%d rows, drift of %s", "rows", "drifted"))
    b = judged.select(F.lit("live_drift").alias("name"), (F.col("drifted") == "").alias("passed"), told.alias("detail"))
    age = F.datediff(end.cast("date"), F.lit(trained_at).cast("date"))
    why = F.when(F.col("drifted") != "", "what is scored has drifted").otherwise(F.format_string("trained %d days ago", age))
    c = judged.select(F.lit("retrain").alias("name"), ((age < retrain_days) & (F.col("drifted") == "")).alias("passed"), why.alias("detail"))
    return a.union(b).union(c)

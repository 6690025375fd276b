"""Searching, paging, counting, upserts and de-duplication over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_tenant(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """The mandatory tenant predicate; another tenant's rows read as absent."""
    if not tenant:
        raise ValueError("a tenant must be named")
    return df.where(F.col(column) == tenant)


def contains_any(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive substring in any column; % and _ are removed from the needle, and an empty one fits all."""
    plain = needle.replace("%", "").replace("_", "").lower()
    if not plain:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(plain)), F.lit(False))
    return out


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in the given total order, each row with the number of rows that match."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Closed range; a null end is open."""
    out = df
    if start is not None:
        out = out.where(F.col(column) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(column) <= F.lit(end))
    return out


def actors(df: DataFrame, kind: str, approver: str = "approver") -> DataFrame:
    return df.where(F.col(approver).isNotNull() if kind == "people" else F.col(approver).isNull())


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def distinct_by_status(df: DataFrame, entity: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """One row: distinct entities in total and with a row in each status, in one pass."""
    return df.agg(F.countDistinct(entity).alias("total"), *(F.countDistinct(F.when(F.col(status) == s, F.col(entity))).alias(s.lower()) for s in statuses))


def next_version(df: DataFrame, by: str, version: str) -> DataFrame:
    return df.groupBy(by).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def having_status(entities: DataFrame, rows: DataFrame, key: str, condition: Column) -> DataFrame:
    return entities.join(rows.where(condition).select(key).distinct(), key, "left_semi")


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The newest row of each key; with append as the only write, this is the table that upserts would leave."""
    own = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def insert_or_ignore(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def newest_per_group(df: DataFrame, group: str, keep: int, *order: str) -> DataFrame:
    own = Window.partitionBy(group).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= keep).drop("__n")


def systematic_sample(df: DataFrame, step: int, most: int, group: str, *order: str) -> DataFrame:
    """Every step-th row of each group in the given order, `most` at most; both are what the operator is for."""
    own = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(own) - 1).where((F.col("__n") % step == 0) & (F.col("__n") < step * most)).drop("__n")


def prune(impressions: DataFrame, feedback: DataFrame, key: str, at: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Both tables without impressions older than the cutoff; their feedback goes with them."""
    kept = impressions.where(F.col(at) >= F.lit(cutoff))
    return kept, feedback.join(kept.select(key), key, "left_semi")


def unsuppressed_alerts(alerts: DataFrame, key: str = "dedupe_key", order: str = "seq") -> DataFrame:
    """Alerts (kind raise or clear) that would be delivered: the first of a key since its last clear; without a key, all."""
    own = Window.partitionBy(key).orderBy(order)
    epochs = alerts.withColumn("__e", F.sum((F.col("kind") == "clear").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    raised = epochs.where("kind = 'raise'")
    first = F.row_number().over(Window.partitionBy(key, "__e").orderBy(order)) == 1
    return raised.withColumn("__f", first).where(F.col("__f") | F.col(key).isNull()).drop("__e", "__f")


def pending_alerts(alerts: DataFrame, attempts: DataFrame, most: int = 5) -> DataFrame:
    """Undelivered alerts with fewer than `most` attempts (alert_id, delivered), oldest first."""
    told = attempts.groupBy("alert_id").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or("delivered").alias("done"))
    rows = alerts.join(told, "alert_id", "left").fillna({"attempts": 0, "done": False})
    return rows.where(~F.col("done") & (F.col("attempts") < most)).drop("done").orderBy("alert_id")


def backfill(df: DataFrame, column: str, *seed: str) -> DataFrame:
    """Nulls of a column filled with a UUID-shaped hash of the row, the same on every run."""
    h = F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in seed)), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return df.withColumn(column, F.coalesce(column, F.concat_ws("-", *parts)))


def relabel_window(df: DataFrame, old: str, new: str, window: str = "window") -> DataFrame:
    """The window `new` is replaced by `old`'s rows."""
    return df.where(F.col(window) != new).withColumn(window, F.when(F.col(window) == old, F.lit(new)).otherwise(F.col(window)))


def slots_of(bookings: DataFrame) -> DataFrame:
    return bookings.select("event_ref", "starts_at", "ends_at", F.explode("attendees").alias("attendee"))


def overlapping(a: DataFrame, b: DataFrame, key: str, start: str, end: str, bucket_seconds: int = 3600) -> DataFrame:
    """Pairs of half-open slots of one key that overlap: a.start < b.end and b.start < a.end.

    Each slot is put under every bucket of time it touches, so that a busy key is split by time; a pair is told in the
    bucket where the later of both begins, hence once.
    """
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    cells = lambda df: df.withColumn("__cell", F.explode(F.sequence(F.floor(sec(F.col(start)) / bucket_seconds), F.floor((sec(F.col(end)) - 1) / bucket_seconds))))
    x, y = cells(a.where(F.col(start) < F.col(end))).alias("a"), cells(b.where(F.col(start) < F.col(end))).alias("b")
    home = F.floor(sec(F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}"))) / bucket_seconds)
    meets = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__cell") == F.col("b.__cell")) & (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}"))
    return x.join(y, meets).where(F.col("a.__cell") == home)


def rate_violations(events: DataFrame, key: Sequence[str], at: str, limit: int, seconds: int = 60) -> DataFrame:
    """Events whose key has more than `limit` within the last `seconds`, itself included."""
    own = Window.partitionBy(*key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(own)).where(F.col("in_window") > limit)


def clean_roles(roles: Column, known: Sequence[str]) -> Column:
    """Trimmed, upper-case, distinct, sorted; unknown ones are refused."""
    own = F.array_sort(F.array_distinct(F.transform(roles, lambda r: F.upper(F.trim(r)))))
    strange = F.array_except(own, F.array(*map(F.lit, known)))
    return F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown roles: "), F.array_join(strange, ", "))).cast("array<string>")).otherwise(own)


def removes_last_admin(keys: DataFrame, key_id: str) -> DataFrame:
    """One row, last: whether no other active key has the role ADMIN."""
    admin = F.exists("roles", lambda r: F.upper(r) == "ADMIN")
    return keys.agg((F.sum((admin & F.col("active") & (F.col("key_id") != key_id)).cast("long")) == 0).alias("last"))


def valid_tokens(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """Tokens whose key is active, of the same tenant, and not older than the key's not_before."""
    k = keys.select("key_id", "tenant_id", "active", "not_before")
    rows = tokens.join(k, ["key_id", "tenant_id"])
    return rows.where(F.col("active") & (F.col("not_before").isNull() | (F.col("issued_at") >= F.col("not_before")))).select(*tokens.columns)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("clicked").cast("long")), F.lit(0)).alias("clicks"))


def credited_feedback(feedback: DataFrame, impressions: DataFrame) -> DataFrame:
    """Feedback on items that its impression (request_id, items array) showed, once per request and item."""
    shown = feedback.join(impressions.select("request_id", "items"), "request_id").where(F.array_contains("items", F.col("item_id"))).drop("items")
    return insert_or_ignore(shown, ["request_id", "item_id"], "at")

"""The guard of a canary: a stateful stream that judges it every 25 impressions and stops or advances it by itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpforge.sources.shared import exists, names_in, scratch, settle


@dataclass(frozen=True)
class GuardLimits:
    least_ctr: float = 0.85
    most_error: float = 0.15
    most_latency: float = 250.0
    minimum: int = 300
    every: int = 25
    #: Impressions after which a canary that was healthy at each check goes live; None leaves that to people.
    advance_after: int | None = None
    keep: int = 5000
    latencies: int = 2000


class _Arm:
    """Counts since the start, and the newest outcomes and latencies of one arm."""

    def __init__(self, limits: GuardLimits, held: tuple | None = None):
        self.limits = limits
        self.impressions, self.clicks, ids, p, y, latency = held or (0, 0, [], [], [], [])
        self.ids, self.p, self.y, self.latency = list(ids), list(p), list(y), list(latency)
        self.at = {i: self.impressions - len(self.ids) + k for k, i in enumerate(self.ids)}

    def held(self) -> tuple:
        self._cut()
        return self.impressions, self.clicks, self.ids, self.p, self.y, self.latency

    def _cut(self) -> None:
        keep = self.limits.keep
        for i in self.ids[:-keep]:
            if self.at.get(i, -1) < self.impressions - keep:
                self.at.pop(i, None)
        self.ids, self.p, self.y, self.latency = self.ids[-keep:], self.p[-keep:], self.y[-keep:], self.latency[-self.limits.latencies :]

    def add(self, request: str, clicked: bool, probability: float, latency: float) -> None:
        self.at[request] = self.impressions
        self.impressions, self.clicks = self.impressions + 1, self.clicks + bool(clicked)
        self.ids.append(request)
        self.p.append(float(probability))
        self.y.append(int(clicked))
        if latency == latency and latency is not None:
            self.latency.append(float(latency))
        if len(self.ids) > 2 * self.limits.keep:
            self._cut()

    def add_all(self, rows: pd.DataFrame) -> None:
        """As add for each row; of more than are kept only the last are looked at one by one."""
        if not len(rows):
            return
        keep, latency = self.limits.keep, rows["latency_ms"].to_numpy(float)
        tail = rows.iloc[-keep:]
        if len(rows) >= keep:
            self.ids, self.p, self.y, self.at = [], [], [], {}
        self.impressions, self.clicks = self.impressions + len(rows), self.clicks + int(rows["clicked"].to_numpy(bool).sum())
        ids = tail["request_id"].tolist()
        self.at.update(zip(ids, range(self.impressions - len(ids), self.impressions), strict=True))
        self.ids += ids
        self.p += tail["probability"].to_numpy(float).tolist()
        self.y += tail["clicked"].to_numpy(bool).astype(int).tolist()
        self.latency += latency[~np.isnan(latency)][-self.limits.latencies :].tolist()
        if len(self.ids) > 2 * keep:
            self._cut()

    def credit(self, request: str) -> bool:
        """A late click turns an impression that is still kept into a click, once."""
        number = self.at.get(request, -1)
        k = number - (self.impressions - len(self.y))
        if number < self.impressions - self.limits.keep or k < 0 or self.y[k]:
            return False
        self.y[k], self.clicks = 1, self.clicks + 1
        return True

    def ctr(self) -> float:
        return self.clicks / self.impressions if self.impressions else 0.0

    def p95(self) -> float:
        ordered = sorted(self.latency[-self.limits.latencies :])
        return ordered[min(len(ordered) - 1, int(0.95 * len(ordered)))] if ordered else 0.0

    def calibration_error(self) -> float:
        p, y = np.array(self.p[-self.limits.keep :]), np.array(self.y[-self.limits.keep :], float)
        cell = sum((p > k / 10).astype(int) for k in range(1, 10))
        return float(sum(abs(p[cell == k].sum() - y[cell == k].sum()) for k in range(10)) / len(p)) if len(p) else 0.0


def reasons(impressions: int, ratio: float, error: float, p95: float, limits: GuardLimits) -> list[str]:
    """What is wrong with a canary; nothing while there is too little to judge."""
    if impressions < limits.minimum:
        return []
    wrong = [f"click-through ratio {ratio:.2f} is below {limits.least_ctr:.2f}"] if ratio < limits.least_ctr else []
    wrong += [f"calibration error {error:.3f} is above {limits.most_error:.3f}"] if error > limits.most_error else []
    wrong += [f"p95 latency {p95:.0f} ms is above {limits.most_latency:.0f} ms"] if p95 > limits.most_latency else []
    return wrong


def verdict(live: _Arm, canary: _Arm, limits: GuardLimits) -> tuple[list[str], float, float, float]:
    """What is wrong with the canary, its click ratio, calibration error and p95."""
    ratio = canary.ctr() / live.ctr() if live.ctr() > 0 else 1.0
    error, p95 = canary.calibration_error(), canary.p95()
    return reasons(canary.impressions, ratio, error, p95, limits), ratio, error, p95


DECISION = "name string, version int, seq long, impressions long, stage string, reasons array<string>, ctr_ratio double, calibration_error double, p95_latency_ms double"
_ARM_STATE = "impressions long, clicks long, ids array<string>, p array<double>, y array<int>, latency array<double>"


def _struct(columns: str) -> str:
    return "struct<" + ", ".join(c.replace(" ", ":", 1) for c in columns.split(", ")) + ">"


_STATE = f"version int, stopped boolean, live {_struct(_ARM_STATE)}, canary {_struct(_ARM_STATE)}"


def guard(outcomes: DataFrame, limits: GuardLimits | None = None) -> DataFrame:
    """A row for each check: name, version, seq, impressions, stage (CANARY, ROLLED_BACK or LIVE), reasons and the figures.

    outcomes is a stream of (name, arm, version, seq, request_id, clicked, probability, latency_ms, is_credit), arm live or
    canary; seq grows with time. A credit is a late click. Every `every`th impression of a canary is a check. After
    ROLLED_BACK or LIVE nothing more is told of that version; an outcome of a later version starts a new canary. State is
    one row a name, bounded by `keep` and `latencies`.
    """
    limits = limits or GuardLimits()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, stopped, live, canary = state.get if state.exists else (-1, False, None, None)
        live, canary = _Arm(limits, live and tuple(live)), _Arm(limits, canary and tuple(canary))
        told = []
        events = pd.concat([p.drop(columns="name").assign(arm=p["arm"] == "canary") for p in parts], ignore_index=True)
        events = events if events["seq"].is_monotonic_increasing else events.sort_values("seq", kind="stable")
        of_canary, versions, credits = events["arm"].to_numpy(bool), events["version"].to_numpy(), events["is_credit"].to_numpy(bool)
        newest = np.maximum.accumulate(np.r_[version, np.where(of_canary, versions, -1)])
        # Between late clicks and first rows of a version nothing but impressions comes, which are counted in runs from check to check.
        turns = np.flatnonzero(credits | (newest[1:] > newest[:-1])).tolist()
        for begun, done in zip([0, *turns], [*turns, len(events)], strict=True):
            if begun < done and of_canary[begun] and versions[begun] > version:
                version, stopped, canary = int(versions[begun]), False, _Arm(limits)
            if begun < done and credits[begun]:
                if not of_canary[begun]:
                    live.credit(events["request_id"].iloc[begun])
                elif versions[begun] == version and not stopped:
                    canary.credit(events["request_id"].iloc[begun])
                begun += 1
            while begun < done:
                upto = done if stopped else min(done, begun + 64 * limits.every)  # a check is near, so the rest is not looked at again for each
                own = begun + np.flatnonzero(of_canary[begun:upto] & (versions[begun:upto] == version)) if not stopped else np.zeros(0, int)
                wait = limits.every - canary.impressions % limits.every
                end = int(own[wait - 1]) + 1 if len(own) >= wait else upto
                run = slice(begun, end)
                live.add_all(events.iloc[run][~of_canary[run]])
                canary.add_all(events.iloc[own[own < end]])
                begun = end
                if len(own) < wait:
                    continue
                wrong, ratio, error, p95 = verdict(live, canary, limits)
                finished = limits.advance_after is not None and canary.impressions >= limits.advance_after
                stage = "ROLLED_BACK" if wrong else "LIVE" if finished else "CANARY"
                stopped = stage != "CANARY"
                told.append((key[0], version, int(events["seq"].iloc[end - 1]), canary.impressions, stage, wrong, ratio, error, p95))
                if stage == "LIVE":
                    live, canary = canary, _Arm(limits)
        state.update((version, stopped, live.held(), canary.held()))
        yield pd.DataFrame(told, columns=[c.split()[0] for c in DECISION.split(", ")])

    return outcomes.groupBy("name").applyInPandasWithState(update, DECISION, _STATE, "append", GroupStateTimeout.NoTimeout)


def registry_events(decisions: DataFrame) -> DataFrame:
    """Registry rows (name, version, seq, stage, actor, reason) of the decisions that end a canary."""
    return decisions.where("stage <> 'CANARY'").select("name", "version", "seq", "stage", F.lit("guard").alias("actor"), F.array_join("reasons", "; ").alias("reason"))


def enforce(path: str):
    """A foreachBatch function that writes what ends canaries to the registry's table; a batch that comes again replaces its rows."""
    return lambda batch, number: registry_events(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")


def enforced(spark, path: str) -> DataFrame:
    schema = "name string, version int, seq long, stage string, actor string, reason string"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


#: Outcomes of a span, which one task replays, about; and of a bin of 2 ** _BIN outcomes, of which spans get as many from before as they need.
SPAN_ROWS, _BIN = 200_000, 12
_ARM = {"ids": "array<string>", "p": "array<double>", "y": "array<int>", "latency": "array<double>"}
_HELD = [f"{arm}_{c} {kind}" for arm in ("live", "canary") for c, kind in _ARM.items()]
HELD = "name string, version int, stopped boolean, live_impressions long, live_clicks long, canary_impressions long, canary_clicks long, " + ", ".join(_HELD)
#: A row of a span's checks, and one (impressions null) that tells how many clicks the span adds; of the last span, also what its arms hold.
_SPAN = "name string, version int, span int, at long, seq long, impressions long, clicks long, live_impressions long, live_clicks long, error double, p95 double, last boolean, " + ", ".join(_HELD)


def judged(outcomes: DataFrame, held: DataFrame, limits: GuardLimits | None = None, span_rows: int = SPAN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Decisions about a batch of outcomes as guard tells them, and what is held after it (HELD, a row a name), given what was held before.

    Verdicts change nothing before the first that ends a canary, so spans of the batch are replayed side by side: each gets
    the newest `keep` outcomes of both arms from before it, and clicks before it are summed over spans afterwards. Only a
    canary that goes live changes what comes after; outcomes from there on are replayed again with it as the live arm.
    """
    limits = limits or GuardLimits()
    order = ["name", "seq", "is_credit", "arm", "request_id"]
    spans = max(1, -(-outcomes.count() // span_rows))
    rows = outcomes.repartitionByRange(spans, *order).sortWithinPartitions(*order).withColumn("canary", F.col("arm") == "canary").drop("arm")
    rows, held, told = settle(rows.withColumn("at", F.monotonically_increasing_id())), settle(held), None
    if spans == 1:
        return _judged(rows, held, limits)
    # Most bad canaries end early: then the rest of the batch is counted and not judged.
    told, held = _judged(rows.where(F.shiftright("at", 33) == 0), held, limits)
    rows = rows.where(F.shiftright("at", 33) > 0)
    ended = held.where("stopped").select("name", F.col("version").alias("ended"))
    moved = rows.join(ended, "name").where("is_credit OR (canary AND version > ended)").select("name").distinct()
    quiet = settle(ended.join(moved, "name", "left_anti").select("name"))
    if quiet.limit(1).count():
        counted = _counted(rows.join(quiet, "name", "left_semi"), held.join(quiet, "name", "left_semi"), limits)
        rows, held = rows.join(quiet, "name", "left_anti"), held.join(quiet, "name", "left_anti")
        if not rows.limit(1).count():
            return told, settle(counted.unionByName(held))
        later, after = _judged(settle(rows), held, limits)
        return told.unionByName(later), settle(counted.unionByName(after))
    later, after = _judged(settle(rows), held, limits)
    return told.unionByName(later), after


def _counted(rows: DataFrame, held: DataFrame, limits: GuardLimits) -> DataFrame:
    """What is held after rows of names whose canary has ended: live outcomes are counted, and a task a name gets only the newest."""
    live = rows.where("NOT canary").withColumn("bin", F.shiftright("at", _BIN))
    bins = settle(live.groupBy("name", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("clicked").cast("long"), F.lit(0))).alias("clicks")))
    newer = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    newest = live.join(bins.withColumn("newer", newer).where(F.col("newer") < limits.keep).select("name", "bin"), ["name", "bin"])

    def add(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(held):
            arm = _Arm(limits, (0, 0, *(held[f"live_{c}"].iloc[0] for c in _ARM)))
            arm.add_all(rows.sort_values("at", kind="stable"))
            for c, now in zip(_ARM, arm.held()[2:], strict=True):
                held[f"live_{c}"] = [now]
        return held

    after = held.join(bins.groupBy("name").agg(F.sum("n").alias("n"), F.sum("clicks").alias("more")), "name", "left")
    after = after.withColumns({"live_impressions": F.col("live_impressions") + F.coalesce("n", F.lit(0)), "live_clicks": F.col("live_clicks") + F.coalesce("more", F.lit(0))}).select(held.columns)
    return newest.select("name", "at", "request_id", "clicked", "probability", "latency_ms").groupBy("name").cogroup(after.groupBy("name")).applyInPandas(add, HELD)


def _judged(rows: DataFrame, held: DataFrame, limits: GuardLimits) -> tuple[DataFrame, DataFrame]:
    """As judged, of rows in the order of `at`, all by spans."""
    told = None
    while True:
        found, after = _replayed(rows, held, limits)
        went_live = found.where("stage = 'LIVE'").groupBy("name").agg(F.min("at").alias("until"))
        if limits.advance_after is None or not went_live.limit(1).count():
            found = found.drop("at")
            return found if told is None else told.unionByName(found), after
        went_live = settle(went_live)
        mine = found.join(went_live, "name", "left").where("until IS NULL OR at <= until").drop("until", "at")
        told = mine if told is None else told.unionByName(mine)
        # What was the canary when it went live is now the live arm of its name; the name's other rows follow in the next round.
        upto = _replayed(settle(rows.join(went_live, "name").where("at <= until").drop("until")), held.join(went_live, "name", "left_semi"), limits, drop=False)[1]
        turned = [F.col(f"canary_{c}").alias(f"live_{c}") for c in ("impressions", "clicks", *_ARM)]
        empty = [F.lit(0).cast("long").alias(f"canary_{c}") for c in ("impressions", "clicks")] + [F.array().cast(kind).alias(f"canary_{c}") for c, kind in _ARM.items()]
        now_live = upto.select("name", "version", F.lit(True).alias("stopped"), *turned, *empty)
        held = settle(now_live.unionByName(after.join(went_live, "name", "left_anti")))
        rows = settle(rows.join(went_live, "name").where("at > until").drop("until"))


def _replayed(rows: DataFrame, held: DataFrame, limits: GuardLimits, drop: bool = True) -> tuple[DataFrame, DataFrame]:
    """Decisions (with `at`) up to the first end of each canary, as if none went live, and what is held after; with drop, nothing of ended ones."""
    # The version that is judged at each row: the highest of a canary so far.
    known = held.select("name", F.col("version").alias("held_version"), F.col("stopped").alias("held_stopped"), F.col("live_impressions").alias("held_live"), F.col("canary_impressions").alias("held_canary"))
    high = F.max(F.when(F.col("canary"), F.col("version")))
    span = F.shiftright("at", 33).cast("int")
    before = Window.partitionBy("name").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("name", span.alias("span")).agg(high.alias("high"))
    starts = starts.withColumn("start", F.max("high").over(before)).join(known, "name", "left")
    starts = settle(starts.select("name", "span", F.greatest(F.col("start"), F.coalesce("held_version", F.lit(-1))).alias("start"), F.coalesce("high", F.lit(-1)).alias("high"), F.coalesce("held_stopped", F.lit(False)).alias("held_stopped"), "held_version"))
    celled = rows.withColumn("span", span).join(starts, ["name", "span"])
    so_far = Window.partitionBy("name", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = lambda c: F.greatest(F.col("start"), c)
    plain = celled.where("high <= start").withColumn("current", F.col("start"))
    risen = celled.where("high > start").withColumn("current", level(F.max(F.when(F.col("canary"), F.col("version"))).over(so_far)))
    celled = plain.unionByName(risen).where("NOT canary OR version = current").where("NOT (canary AND held_stopped AND current = held_version)")
    celled = celled.select("name", "current", "span", F.shiftright("at", _BIN).alias("bin"), "at", "canary", "seq", "request_id", "clicked", "probability", "latency_ms", "is_credit")

    # What was held counts as rows before all others: outcomes without their latencies, and latencies alone.
    def past(arm: str) -> DataFrame:
        both = held if arm == "live" else held.where("NOT stopped")
        lists = F.transform(F.arrays_zip(*(F.col(f"{arm}_{c}").alias(c) for c in ("ids", "p", "y"))), lambda x: F.struct(x["ids"].alias("request_id"), (x["y"] == 1).alias("clicked"), x["p"].alias("probability"), F.lit(None).cast("double").alias("latency_ms")))
        alone = F.transform(f"{arm}_latency", lambda x: F.struct(F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("boolean").alias("clicked"), F.lit(None).cast("double").alias("probability"), x.alias("latency_ms")))
        out = both.select("name", F.col("version").alias("current"), F.posexplode(F.concat(alone, lists) if arm == "canary" else lists).alias("k", "x"))
        return out.select("name", "current", F.lit(-1).alias("span"), F.lit(-1).cast("long").alias("bin"), (F.col("k") - (1 << 40)).cast("long").alias("at"), F.lit(arm == "canary").alias("canary"), F.lit(None).cast("long").alias("seq"), "x.*", F.lit(False).alias("is_credit"))

    celled = celled.unionByName(past("live")).unionByName(past("canary"))
    shown = lambda canary: F.sum(((F.col("canary") == F.lit(canary)) & ~F.col("is_credit") & (F.col("clicked").isNotNull() | (F.col("bin") >= 0))).cast("long"))
    timed = F.sum((F.col("canary") & ~F.col("is_credit") & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")).cast("long"))
    bins = celled.groupBy("name", "current", "span", "bin").agg(shown(False).alias("live"), shown(True).alias("shown"), timed.alias("timed")).join(known, "name", "left")
    plan = settle(bins.groupBy("name").applyInPandas(_plan(limits), "name string, current int, bin long, to array<struct<span:int,what:int>>, base_live long, base_canary long, last boolean"))
    dealt = celled.drop("span").join(plan, ["name", "current", "bin"]).withColumn("to", F.explode("to"))
    what = F.col("to.what")
    dealt = dealt.withColumn("span", F.col("to.span")).withColumn("what", F.when(what == 0, 0).when(~F.col("canary"), F.when(what.bitwiseAND(1) > 0, 1)).when(what.bitwiseAND(2) > 0, 1).when((what.bitwiseAND(4) > 0) & F.col("latency_ms").isNotNull() & ~F.col("is_credit"), 2)).where("what IS NOT NULL")
    replayed = settle(dealt.drop("to", "bin").groupBy("name", "span").applyInPandas(_span(limits), _SPAN))

    ends = replayed.where("impressions IS NULL")
    earlier = Window.partitionBy("name").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    of_version = Window.partitionBy("name", "version").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    clicks = held.select("name", F.col("live_clicks").alias("held_live_clicks"), F.col("canary_clicks").alias("held_clicks"), F.col("version").alias("held_version"), F.col("live_impressions").alias("held_live"), F.col("canary_impressions").alias("held_shown"), F.col("stopped").alias("held_stopped"))
    held_or = lambda c, test=F.lit(True): F.when(test, F.coalesce(c, F.lit(0))).otherwise(0)
    same = F.col("held_version") == F.col("version")
    sums = ends.select("name", "version", "span", F.coalesce(F.sum("live_clicks").over(earlier), F.lit(0)).alias("a"), F.coalesce(F.sum("clicks").over(of_version), F.lit(0)).alias("b")).join(clicks, "name", "left")
    sums = settle(sums.select("name", "span", (F.col("a") + held_or(F.col("held_live_clicks"))).alias("live_before"), (F.col("b") + held_or(F.col("held_clicks"), same)).alias("before"), F.coalesce(same & F.col("held_stopped"), F.lit(False)).alias("was_stopped")))
    checks = replayed.where("impressions IS NOT NULL").select(*[c.split()[0] for c in _SPAN.split(", ")[:11]]).join(sums, ["name", "span"])
    told = settle(checks.where("NOT was_stopped").mapInPandas(_stages(limits), DECISION + ", at long"))
    first = told.where("stage <> 'CANARY'").groupBy("name", "version").agg(F.min("at").alias("first"))
    told = told.join(first, ["name", "version"], "left").where("first IS NULL OR at <= first").drop("first")

    arms = ends.where("last").join(sums, ["name", "span"]).join(first, ["name", "version"], "left").withColumn("stopped", F.col("was_stopped") | F.col("first").isNotNull())
    gone = F.col("stopped") & F.lit(drop)
    canary = [F.when(gone, F.array().cast(kind)).otherwise(F.col(f"canary_{c}")).alias(f"canary_{c}") for c, kind in _ARM.items()]
    after = arms.select(
        "name", "version", "stopped", "live_impressions", (F.col("live_before") + F.col("live_clicks")).alias("live_clicks"), F.when(gone, 0).otherwise(F.col("seq")).alias("canary_impressions"),
        F.when(gone, 0).otherwise(F.col("before") + F.col("clicks")).alias("canary_clicks"), *(f"live_{c}" for c in _ARM), *canary,
    )
    return told, settle(after.unionByName(held.join(ends.select("name").distinct(), "name", "left_anti")))


def _plan(limits: GuardLimits):
    """A grouped map: for each bin of a name the spans that get its rows; what is 0 for its own, else bits for live, canary and latencies alone.

    A span here is a stretch of one span of the batch in which one version is judged; they are numbered in order.
    """

    def plan(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["current", "span", "bin"], kind="stable").reset_index(drop=True)
        first = bins.iloc[0]
        known = lambda c: 0 if pd.isna(first[c]) else int(first[c])
        real, version = bins["bin"].to_numpy() >= 0, bins["current"].to_numpy()
        turn = np.r_[True, (version[1:] != version[:-1]) | (np.diff(bins["span"].to_numpy()) != 0)]
        number = np.cumsum(turn & real) - 1
        counts = {c: np.r_[0, np.cumsum(bins[c].to_numpy())] for c in ("live", "shown", "timed")}
        to: list[list[dict]] = [[{"span": int(s), "what": 0}] if r else [] for s, r in zip(number, real, strict=True)]
        base = np.zeros((len(bins), 2), np.int64)
        past = int((~real).sum() and bins.loc[~real, "live"].sum())
        begun = np.flatnonzero(turn & real)
        for k, done in zip(begun, [*begun[1:], len(bins)], strict=False):  # none, if a name has nothing but what was held
            same = int(np.searchsorted(version, version[k]))  # the first bin of its version
            old = counts["shown"][np.searchsorted(version, version[k]) + int((~real[same:k]).sum())] - counts["shown"][same] if k > same else 0
            own_version = not pd.isna(first["held_version"]) and int(first["held_version"]) == int(version[k])
            base[k:done] = known("held_live") + counts["live"][k] - past, (known("held_canary") if own_version else 0) + counts["shown"][k] - counts["shown"][same] - old
            for column, keep, least, bit in (("live", limits.keep, 0, 1), ("shown", limits.keep, same, 2), ("timed", limits.latencies, same, 4)):
                # Bins after which, before this span, fewer than `keep` come.
                begin = max(least, int(np.searchsorted(counts[column][1 : k + 1], counts[column][k] - keep, "right")))
                for j in range(begin, k):
                    if to[j] and to[j][-1]["span"] == number[k]:
                        to[j][-1]["what"] |= bit
                    else:
                        to[j].append({"span": int(number[k]), "what": bit})
        return pd.DataFrame({"name": bins["name"], "current": version, "bin": bins["bin"], "to": to, "base_live": base[:, 0], "base_canary": base[:, 1], "last": number == number[-1]})

    return plan


def _span(limits: GuardLimits):
    """A grouped map: checks of a span from its rows (what is 0), rows of before (1) and latencies of before (2), with clicks since it began."""

    def replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        what = rows["what"].to_numpy()
        live, canary = _Arm(limits), _Arm(limits)
        held_latency = (what == 1) & (rows["at"].to_numpy() < 0) & rows["clicked"].isna().to_numpy()
        alone = rows["latency_ms"].to_numpy(float)[(what == 2) | held_latency]
        canary.latency = alone[~np.isnan(alone)][-limits.latencies :].tolist()
        before = rows[(what == 1) & ~held_latency]
        own, told = rows[what == 0], []
        _runs(before, live, canary, limits, None)
        version, last = int(own["current"].iloc[0]), bool(own["last"].iloc[0])
        live = _Arm(limits, (int(own["base_live"].iloc[0]), 0, *live.held()[2:]))
        canary = _Arm(limits, (int(own["base_canary"].iloc[0]), 0, *canary.held()[2:]))
        _runs(own, live, canary, limits, told)
        arms = [live.held()[2:], canary.held()[2:]] if last else [(None,) * 4] * 2
        end = (key[0], version, key[1], int(own["at"].iloc[-1]), canary.impressions, None, canary.clicks, live.impressions, live.clicks, None, None, last, *arms[0], *arms[1])
        told = [(key[0], version, key[1], *t, False, *(None,) * 8) for t in told]
        out = pd.DataFrame([*told, end], columns=[c.split()[0] for c in _SPAN.split(", ")])
        return out.astype({"impressions": "Int64"})

    return replay


def _runs(events: pd.DataFrame, live: _Arm, canary: _Arm, limits: GuardLimits, told: list | None) -> None:
    """Adds events of one version to both arms in order; into told go the checks, up to the first that is known to end the canary."""
    of_canary, credits, ended = events["canary"].to_numpy(bool), events["is_credit"].to_numpy(bool), told is None
    turns = np.flatnonzero(credits).tolist()
    ids, at, seq = events["request_id"].to_numpy(), events["at"].to_numpy(), events["seq"].to_numpy()
    for begun, done in zip([0, *turns], [*turns, len(events)], strict=True):
        if begun < done and credits[begun]:
            (canary if of_canary[begun] else live).credit(ids[begun])
            begun += 1
        while begun < done:
            upto = done if ended else min(done, begun + 64 * limits.every)
            own = begun + np.flatnonzero(of_canary[begun:upto])
            wait = limits.every - canary.impressions % limits.every
            check = not ended and len(own) >= wait
            end = int(own[wait - 1]) + 1 if check else upto
            part = events.iloc[begun:end]
            live.add_all(part[~of_canary[begun:end]])
            canary.add_all(part[of_canary[begun:end]])
            begun = end
            if check:
                error, p95 = canary.calibration_error(), canary.p95()
                told.append((int(at[end - 1]), int(seq[end - 1]), canary.impressions, canary.clicks, live.impressions, live.clicks, error, p95))
                finished = limits.advance_after is not None and canary.impressions >= limits.advance_after
                ended = finished or canary.impressions >= limits.minimum and (error > limits.most_error or p95 > limits.most_latency)


def _stages(limits: GuardLimits):
    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            told = []
            for e in part.itertuples():
                ctr = (e.live_before + e.live_clicks) / e.live_impressions if e.live_impressions else 0.0
                ratio = (e.before + e.clicks) / e.impressions / ctr if ctr > 0 else 1.0
                wrong = reasons(e.impressions, ratio, e.error, e.p95, limits)
                finished = limits.advance_after is not None and e.impressions >= limits.advance_after
                told.append((e.name, e.version, e.seq, e.impressions, "ROLLED_BACK" if wrong else "LIVE" if finished else "CANARY", wrong, ratio, e.error, e.p95, e.at))
            yield pd.DataFrame(told, columns=[c.split()[0] for c in DECISION.split(", ")] + ["at"])

    return decide


def drained(outcomes: DataFrame, limits: GuardLimits | None = None, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Decisions about a stream of outcomes over what is there now: batch by batch, each judged by spans. A batch that comes again replaces its own files."""
    path = scratch(outcomes.sparkSession, "guard")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in (int(x.split("=")[1]) for x in names_in(spark, f"{path}/held") if x.startswith("batch=")) if n < number]
        held = spark.read.schema(HELD).parquet(f"{path}/held/batch={max(earlier)}") if earlier else spark.createDataFrame([], HELD)
        told, after = judged(batch, held, limits, span_rows)
        told.write.mode("overwrite").parquet(f"{path}/told/batch={number}")
        after.write.mode("overwrite").parquet(f"{path}/held/batch={number}")

    outcomes.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start().awaitTermination()
    spark = outcomes.sparkSession
    return spark.read.schema(DECISION).option("recursiveFileLookup", "true").parquet(f"{path}/told") if exists(spark, f"{path}/told") else spark.createDataFrame([], DECISION)

"""Group statistics: adverse impact, drift, calibration, experiments, rollout guard, determinism and fidelity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpforge.functions.numeric import chi_squared_p, drift_severity, two_sample_p

# Order statistics without a task that orders a whole group


def sums_below(rows: DataFrame, by: Sequence[str], value: str, columns: Sequence[str], cells: int = 64) -> DataFrame:
    """rows (one per `by` and value) with <column>_below: the sum of the column over smaller values of the same group.

    A sketch of each group's values cuts them in cells; sums run inside a cell, and the cells' totals, at most `cells`
    per group, are summed apart. So a group with most of the rows is still dealt over its cells, and the result is exact.
    """
    grid = F.array(*(F.lit(k / cells) for k in range(1, cells)))
    group = [F.lit(0).alias("__all")] if not by else []
    keys = list(by) or ["__all"]
    rows = rows.select("*", *group)
    edges = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, grid, 1000)).alias("__edges"))
    celled = rows.join(edges, keys).withColumn("__cell", F.aggregate("__edges", F.lit(0), lambda n, e: n + (e < F.col(value)).cast("int"))).drop("__edges")
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = celled.groupBy(*keys, "__cell").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    totals = totals.select(*keys, "__cell", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = celled.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_below") for c in columns))
    joined = run.join(totals, [*keys, "__cell"])
    return joined.select(*(c for c in rows.columns if c != "__all"), *((F.col(f"{c}_below") + F.col(f"__{c}")).alias(f"{c}_below") for c in columns))


def exact_quantiles(values: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, quantiles, n: linear interpolation between order statistics, which are found by rank among distinct values."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("__n"))
    ranked = sums_below(counts, by, value, ["n"]).join(total, list(by))
    at = lambda rank: F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n")), F.col(value)))
    place = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    found = ranked.groupBy(*by).agg(
        F.max("__n").alias("n"), *(at(F.floor(place(p))).alias(f"__lo{k}") for k, p in enumerate(shares)), *(at(F.ceil(place(p))).alias(f"__hi{k}") for k, p in enumerate(shares))
    )
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return found.select(*by, F.array(*(F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * part(p) for k, p in enumerate(shares))).alias("quantiles"), "n")


# Adverse impact


def selection_outcomes(df: DataFrame, group: str, selected: Column) -> DataFrame:
    return df.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(selected, F.lit(False)).cast("long")).alias("selected"))


def four_fifths(outcomes: DataFrame, minimum: int = 30, threshold: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """grp, total, selected, rate, eligible, ratio, impacted, verdict per group.

    Groups below `minimum` take no part. The reference is the highest rate, the ratio is to it, impacted is a ratio
    strictly below the threshold. Fewer than two eligible groups or a highest rate of 0 give INSUFFICIENT_DATA. With
    `by`, each combination of those columns is a report of its own.
    """
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rated = outcomes.withColumn("rate", F.col("selected") / F.when(F.col("total") > 0, F.col("total"))).withColumn("eligible", F.col("total") >= minimum)
    rated = rated.withColumn("best", F.max(F.when(F.col("eligible"), F.col("rate"))).over(every)).withColumn("parties", F.sum(F.col("eligible").cast("int")).over(every))
    enough = (F.col("parties") >= 2) & (F.col("best") > 0)
    ratio = F.when(enough & F.col("eligible"), F.col("rate") / F.when(F.col("best") > 0, F.col("best")))
    out = rated.withColumn("ratio", ratio).withColumn("impacted", F.coalesce(F.col("ratio") < threshold, F.lit(False)))
    any_hit = F.max(F.col("impacted").cast("int")).over(every) == 1
    verdict = F.when(~F.coalesce(enough, F.lit(False)), F.lit("INSUFFICIENT_DATA")).when(any_hit, F.lit("ADVERSE_IMPACT")).otherwise(F.lit("NO_ADVERSE_IMPACT"))
    return out.withColumn("verdict", verdict).select(*by, "grp", "total", "selected", "rate", "eligible", "ratio", "impacted", "verdict")


def impact_summary(report: DataFrame) -> DataFrame:
    """verdict, reference group (first of equals), worst group and a sentence."""
    best = F.max_by("grp", F.struct(F.col("rate"), F.hash("grp") * 0)).alias("reference")
    worst = F.min_by("grp", F.struct("ratio", "grp"))
    row = report.where("eligible").agg(F.first("verdict").alias("verdict"), best, worst.alias("worst"), F.min("ratio").alias("ratio"))
    return row.withColumn("summary", F.format_string("%s: %s is selected at %.2f of the rate of %s", "verdict", "worst", "ratio", "reference"))


def independence_test(outcomes: DataFrame, minimum: int = 30) -> DataFrame:
    """statistic, dof, p_value of the 2 x G table of eligible groups; null where a row sums to 0; Yates' correction for two groups."""
    groups = outcomes.where(F.col("total") >= minimum)
    sums = groups.agg(F.sum("total").alias("n"), F.sum("selected").alias("s"), F.count(F.lit(1)).alias("g"))
    each = groups.crossJoin(F.broadcast(sums))  # one row
    expected, missed = F.col("total") * F.col("s") / F.col("n"), F.col("total") * (F.col("n") - F.col("s")) / F.col("n")
    gap = F.abs(F.col("selected") - expected)
    gap = F.when(F.col("g") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    fine = (F.col("s") > 0) & (F.col("s") < F.col("n")) & (F.col("g") >= 2)
    term = F.when(fine, gap * gap / F.when(expected > 0, expected) + gap * gap / F.when(missed > 0, missed))
    total = each.agg(F.sum(term).alias("statistic"), (F.max("g") - 1).alias("dof"))
    return total.withColumn("p_value", chi_squared_p(F.col("statistic"), F.col("dof")))


def rescreened(df: DataFrame, group: str, screen, dropped: str, minimum: int = 30) -> DataFrame:
    """Impact of a screening rule with and without one column: screen takes the frame and gives a boolean column."""
    variants = {"all_columns": df, f"without_{dropped}": df.withColumn(dropped, F.lit(None).cast(df.schema[dropped].dataType))}
    parts = [four_fifths(selection_outcomes(v, group, screen(v)), minimum).withColumn("variant", F.lit(k)) for k, v in variants.items()]
    return reduce(DataFrame.unionByName, parts)


# Drift


def _shares(counts: DataFrame, key: Sequence[str], floor: float) -> DataFrame:
    """feature, bin, reference and live shares, clipped at the floor, and each bin's contribution."""
    every = Window.partitionBy(*key)
    share = lambda c: F.greatest(F.lit(floor), F.try_divide(F.col(c), F.sum(c).over(every)))
    out = counts.withColumn("reference", share("n_ref")).withColumn("live", share("n_live"))
    return out.withColumn("contribution", (F.col("live") - F.col("reference")) * F.log(F.col("live") / F.col("reference")))


def _binned(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by feature and bin; a bin is the number of inner edges that are not above the value."""
    placed = values.join(F.broadcast(edges), "feature").withColumn("bin", F.aggregate("inner", F.lit(0), lambda n, e: n + (e <= F.col("value")).cast("int")))
    live = F.col("is_live")
    return placed.groupBy("feature", "bin").agg(F.sum((~live).cast("long")).alias("n_ref"), F.sum(live.cast("long")).alias("n_live"))


def _decile_edges(values: DataFrame, bins: int) -> DataFrame:
    """One row per feature: as many edges as bins, so its size follows the number of features only."""
    found = exact_quantiles(values.where(~F.col("is_live")), ["feature"], "value", [k / bins for k in range(bins + 1)])
    return found.withColumnRenamed("quantiles", "edges")


def psi_edges_first(values: DataFrame, bins: int = 10, floor: float = 1e-6, distinct_limit: int = 12) -> DataFrame:
    """feature, psi, severity: population stability where the outer edges become infinite before equal edges merge.

    values is (feature, value, is_live). Up to distinct_limit distinct reference values (to 9 decimals) are categories,
    to which live values snap (the lower of equally near ones). Fewer than 2 rows on a side or fewer than 3 edges: 0.
    """
    rounded = F.round("value", 9)
    reference = values.where(~F.col("is_live"))
    kinds = reference.groupBy("feature").agg(F.countDistinct(rounded).alias("kinds"))
    discrete = kinds.where(F.col("kinds") <= distinct_limit).select("feature")
    categories = reference.join(F.broadcast(discrete), "feature").groupBy("feature").agg(F.array_sort(F.collect_set(rounded)).alias("cats"))
    snapped = values.join(F.broadcast(categories), "feature").withColumn(
        "bin", F.array_min(F.transform("cats", lambda c: F.struct(F.abs(F.col("value") - c).alias("d"), c.alias("c"))))["c"]
    )
    by_value = snapped.groupBy("feature", "bin").agg(F.sum((~F.col("is_live")).cast("long")).alias("n_ref"), F.sum(F.col("is_live").cast("long")).alias("n_live"))
    edges = _decile_edges(values, bins).join(F.broadcast(kinds.where(F.col("kinds") > distinct_limit)), "feature")
    inner = F.array_distinct(F.slice("edges", 2, bins - 1))
    by_decile = _binned(values, edges.select("feature", inner.alias("inner")).where(F.size("inner") >= 1))
    counted = by_value.select("feature", F.col("bin").cast("double").alias("bin"), "n_ref", "n_live").union(by_decile.select("feature", F.col("bin").cast("double"), "n_ref", "n_live"))
    return _psi_of(counted, values, floor, ("stable", "warn", "alert"))


def _psi_of(counted: DataFrame, values: DataFrame, floor: float, labels: Sequence[str]) -> DataFrame:
    sums = _shares(counted, ["feature"], floor).groupBy("feature").agg(F.sum("contribution").alias("psi"))
    sizes = values.groupBy("feature").agg(F.sum((~F.col("is_live")).cast("long")).alias("n_ref"), F.sum(F.col("is_live").cast("long")).alias("n_live"))
    psi = F.when((F.col("n_ref") < 2) | (F.col("n_live") < 2), F.lit(0.0)).otherwise(F.coalesce("psi", F.lit(0.0)))
    return sizes.join(sums, "feature", "left").select("feature", psi.alias("psi")).withColumn("severity", drift_severity(F.col("psi"), labels=labels))


def psi_merge_first(values: DataFrame, buckets: int = 10, floor: float = 1e-6) -> DataFrame:
    """feature, bin, reference, live, contribution, psi, severity: equal edges merge before the outer ones become infinite.

    Needs at least `buckets` reference rows of a feature; others are left out. Fewer than two edges: one row, psi 0.
    """
    edges = _decile_edges(values, buckets).where(F.col("n") >= buckets).withColumn("edges", F.array_distinct("edges"))
    inner = F.when(F.size("edges") > 2, F.expr("slice(edges, 2, size(edges) - 2)")).otherwise(F.array().cast("array<double>"))
    counted = _shares(_binned(values, edges.select("feature", inner.alias("inner"))), ["feature"], floor)
    every = Window.partitionBy("feature")
    return counted.withColumn("psi", F.sum("contribution").over(every)).withColumn("severity", drift_severity(F.col("psi"))).drop("n_ref", "n_live")


def psi_categorical(values: DataFrame, floor: float = 1e-6) -> DataFrame:
    """feature, category, reference, live, contribution, psi, severity over the union of both sides' categories."""
    counts = values.groupBy("feature", "category").agg(F.sum((~F.col("is_live")).cast("long")).alias("n_ref"), F.sum(F.col("is_live").cast("long")).alias("n_live"))
    every = Window.partitionBy("feature")
    shared = _shares(counts, ["feature"], floor).withColumn("psi", F.sum("contribution").over(every))
    return shared.withColumn("severity", drift_severity(F.col("psi"))).drop("n_ref", "n_live")


def ks_test(values: DataFrame, alpha: float = 0.05, moderate: float = 0.2) -> DataFrame:
    """feature, statistic, p_value, severity: the largest gap of both distribution functions, over distinct values.

    p_value is exact for samples without ties that are small enough to count (two_sample_p), else asymptotic; null where a
    side has no rows.
    """
    counts = values.groupBy("feature", "value").agg(F.sum((~F.col("is_live")).cast("long")).alias("a"), F.sum(F.col("is_live").cast("long")).alias("b"))
    sizes = counts.groupBy("feature").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    run = sums_below(counts, ["feature"], "value", ["a", "b"]).join(sizes, "feature")
    gap = F.try_divide(F.col("a_below") + F.col("a"), F.col("n")) - F.try_divide(F.col("b_below") + F.col("b"), F.col("m"))
    out = run.groupBy("feature").agg(F.max(F.abs(gap)).alias("statistic"), F.first("n").alias("n"), F.first("m").alias("m"))
    out = out.withColumn("p_value", F.when(F.least("n", "m") > 0, two_sample_p(F.col("statistic"), F.col("n"), F.col("m"))))
    severity = F.when(F.col("p_value") >= alpha, F.lit("STABLE")).when(F.col("statistic") < moderate, F.lit("MODERATE")).otherwise(F.lit("SIGNIFICANT"))
    return out.withColumn("severity", severity).drop("n", "m")


def drift_verdict(values: DataFrame, alpha: float = 0.01) -> DataFrame:
    """feature, psi, severity, ks, p_value, drifted: severity by psi, drifted if it isn't stable and the KS tail is below alpha."""
    ks = ks_test(values).select("feature", F.col("statistic").alias("ks"), "p_value")
    both = psi_edges_first(values).join(ks, "feature")
    return both.withColumn("drifted", (F.col("severity") != "stable") & (F.col("p_value") < alpha))


def matrix_values(df: DataFrame, features: Sequence[str], is_live: Column) -> DataFrame:
    """feature, value, is_live rows of a wide table: all features in one plan."""
    told = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*(F.col(f).cast("double") for f in features)))
    return df.select(is_live.alias("is_live"), F.explode(told).alias("feature", "value")).where("value IS NOT NULL")


def drift_requests(numeric: DataFrame, categorical: DataFrame, methods: dict[str, str]) -> DataFrame:
    """feature, metric, statistic, severity for features that each ask for psi, ks or categorical."""
    asked = lambda m: [f for f, x in methods.items() if x == m] or [""]
    psi = psi_merge_first(numeric.where(F.col("feature").isin(*asked("psi")))).select("feature", F.lit("psi").alias("metric"), F.col("psi").alias("statistic"), "severity").distinct()
    ks = ks_test(numeric.where(F.col("feature").isin(*asked("ks")))).select("feature", F.lit("ks").alias("metric"), "statistic", "severity")
    cat = psi_categorical(categorical.where(F.col("feature").isin(*asked("categorical")))).select("feature", F.lit("categorical").alias("metric"), F.col("psi").alias("statistic"), "severity").distinct()
    return psi.union(ks).union(cat)


def severity_rank(severity: Column) -> Column:
    low = F.upper(severity)
    return F.when(low.isin("SIGNIFICANT", "ALERT"), 2).when(low.isin("MODERATE", "WARN"), 1).otherwise(0)


def worst_severity(reports: DataFrame) -> DataFrame:
    return reports.agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("worst"))


# Calibration and classification


def calibration_error(df: DataFrame, probability: str, outcome: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """ece and rows: bins are (low, high], compared with the literal edges k / bins; 0 belongs to the first."""
    p = F.col(probability)
    at = sum(((p > k / bins).cast("int") for k in range(1, bins)), F.lit(0))
    cells = df.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(F.col(outcome).cast("double")).alias("y"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), F.sum("n").alias("rows"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """auc by rank sum with average ranks of ties; 0.5 where only one class is there. Works on counts of distinct scores."""
    positive = F.col(label).cast("double") > 0.5
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    wins = F.col("p") * (F.col("n_below") + F.col("n") / 2)
    sums = sums_below(counts.where("s IS NOT NULL"), by, "s", ["n"]).select(*by, wins.alias("w"), "p", "n").groupBy(*by).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pairs = F.col("p") * F.col("n")
    return sums.select(*by, F.when(pairs > 0, F.col("w") / pairs).otherwise(0.5).alias("auc"))


# Experiments


def assign_variant(position: Column, variants: Sequence[tuple[str, float]], holdout: float = 0.0) -> Column:
    """position in [0, 1): a holdout slice first, the rest by cumulative weight, the last variant for what rounding leaves."""
    if not variants or any(w <= 0 for _, w in variants) or not 0 <= holdout < 1:
        raise ValueError("variants need positive weights and the holdout must be in [0, 1)")
    rest, total, so_far = (position - holdout) / (1.0 - holdout), sum(w for _, w in variants), 0.0
    out = F.when(position < holdout, F.lit("holdout"))
    for name, weight in variants:
        so_far += weight / total
        out = out.when(rest < so_far, F.lit(name))
    return out.otherwise(F.lit(variants[-1][0]))


def arm_counts(df: DataFrame, variant: str, success: Column) -> DataFrame:
    """variant, trials, successes; the holdout isn't counted."""
    kept = df.where(F.col(variant) != "holdout")
    return kept.groupBy(F.col(variant).alias("variant")).agg(F.count(F.lit(1)).alias("trials"), F.sum(success.cast("long")).alias("successes"))


def mixture_sprt(counts: DataFrame, alpha: float = 0.05, tau: float = 0.1, minimum: int = 200) -> DataFrame:
    """Adds likelihood_ratio, lift and decision to (control_successes, control_trials, treatment_successes, treatment_trials)."""
    if not 0 < alpha < 1 or tau <= 0:
        raise ValueError("alpha must be in (0, 1) and tau positive")
    cs, ct, ts, tt = (F.col(c).cast("double") for c in ("control_successes", "control_trials", "treatment_successes", "treatment_trials"))
    fine = (ct > 0) & (tt > 0)
    samples, rate_c, rate_t = ct + tt, F.when(ct > 0, cs / ct).otherwise(0.0), F.when(tt > 0, ts / tt).otherwise(0.0)
    pooled = F.when(samples > 0, (cs + ts) / samples)
    variance = pooled * (1 - pooled)
    effective = F.when(fine, ct * tt / samples)
    gap, prior = rate_t - rate_c, tau * tau
    spread = variance + effective * prior
    exponent = effective * effective * prior * gap * gap / (2 * variance * spread)
    ratio = F.sqrt(variance / spread) * F.exp(F.least(exponent, F.lit(700.0)))
    ready = fine & (samples >= minimum) & (variance > 0)
    likelihood = F.when(ready, ratio).otherwise(1.0)
    decision = (
        F.when(ready & (likelihood >= 1 / alpha) & (gap > 0), "TREATMENT_WINS").when(ready & (likelihood >= 1 / alpha), "CONTROL_WINS")
        .when(ready & (likelihood <= alpha), "NO_DIFFERENCE").otherwise("CONTINUE")
    )
    bad = (cs > ct) | (ts > tt) | (F.least(cs, ct, ts, tt) < 0)
    checked = F.when(bad, F.raise_error(F.lit("successes must lie between 0 and trials"))).otherwise(decision)
    return counts.select("*", rate_c.alias("control_rate"), rate_t.alias("treatment_rate"), F.when(rate_c > 0, gap / rate_c).otherwise(0.0).alias("lift"), likelihood.alias("likelihood_ratio"), checked.alias("decision"))


def beta_posterior(df: DataFrame, arm: str, reward: str, order: str | None = None, decay: float = 1.0) -> DataFrame:
    """arm, successes, failures, mean, sd of Beta(1 + sum r, 1 + sum (1 - r)); each update of an arm fades its earlier ones."""
    weight = F.lit(1.0)
    if decay < 1:
        own = Window.partitionBy(arm)
        df = df.withColumn("__age", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy(order)))
        weight = F.pow(F.lit(decay), F.col("__age"))
    r = F.col(reward)
    sums = df.groupBy(F.col(arm).alias("arm")).agg((1 + F.sum(r * weight)).alias("successes"), (1 + F.sum((1 - r) * weight)).alias("failures"))
    s, f = F.col("successes"), F.col("failures")
    return sums.select("arm", "successes", "failures", (s / (s + f)).alias("mean"), F.sqrt(s * f / ((s + f) * (s + f) * (s + f + 1))).alias("sd"))


def serving_window(df: DataFrame, window: str, order: Sequence[str], keep: int = 5000, latencies: int = 2000) -> DataFrame:
    """Of each window's newest rows: impressions, ctr, p95 (the value at index int(0.95 n)), calibration gap.

    df is (window, clicked, probability, latency_ms, ...). The two limits are the feature: a count-based sliding window.
    """
    newest = df.withColumn("__n", F.row_number().over(Window.partitionBy(window).orderBy(*(F.desc(c) for c in order)))).where(F.col("__n") <= keep)
    sums = newest.groupBy(window).agg(
        F.count(F.lit(1)).alias("impressions"), F.avg(F.col("clicked").cast("double")).alias("ctr"), F.abs(F.avg("probability") - F.avg(F.col("clicked").cast("double"))).alias("calibration_error")
    )
    timed = newest.where((F.col("__n") <= latencies) & F.col("latency_ms").isNotNull())
    ranked = timed.select(window, "latency_ms", F.row_number().over(Window.partitionBy(window).orderBy("latency_ms")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(window)).alias("n"))
    p95 = ranked.where(F.col("k") - 1 == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).select(window, F.col("latency_ms").alias("p95_latency_ms"))
    return sums.join(p95, window, "left").withColumn("p95_latency_ms", F.coalesce("p95_latency_ms", F.lit(0.0)))


def rollout_verdict(windows: DataFrame, baseline: str, candidate: str, window: str = "window", minimum: int = 300, least_ctr: float = 0.85, most_error: float = 0.15, most_latency: float = 250.0) -> DataFrame:
    """healthy, reasons, ctr_ratio, calibration_error, p95_latency_ms of the candidate against the baseline."""
    pick = lambda name, c: F.max(F.when(F.col(window) == name, F.col(c)))
    row = windows.agg(*(pick(candidate, c).alias(c) for c in ("impressions", "ctr", "calibration_error", "p95_latency_ms")), pick(baseline, "ctr").alias("base_ctr"))
    ratio = F.when(F.col("base_ctr") > 0, F.coalesce("ctr", F.lit(0.0)) / F.col("base_ctr")).otherwise(1.0)
    row = row.withColumn("ctr_ratio", ratio)
    told = F.array_compact(F.array(
        F.when(F.col("ctr_ratio") < least_ctr, F.format_string("click-through ratio %.2f is below %.2f", "ctr_ratio", F.lit(least_ctr))),
        F.when(F.col("calibration_error") > most_error, F.format_string("calibration error %.3f is above %.3f", "calibration_error", F.lit(most_error))),
        F.when(F.col("p95_latency_ms") > most_latency, F.format_string("p95 latency %.0f ms is above %.0f ms", "p95_latency_ms", F.lit(most_latency))),
    ))
    little = F.coalesce(F.col("impressions"), F.lit(0)) < minimum
    reasons = F.when(little, F.array(F.lit("too few impressions to judge"))).otherwise(told)
    return row.select((little | (F.size(told) == 0)).alias("healthy"), reasons.alias("reasons"), "ctr_ratio", "calibration_error", "p95_latency_ms")


# Determinism and fidelity


def determinism(df: DataFrame, case: str, output: str, near: float = 0.95, unstable: float = 0.60) -> DataFrame:
    """case, repetitions, distinct_outputs, modal_output, modal_share, stability, passes; the first of equally frequent outputs."""
    counts = df.groupBy(F.col(case).alias("case"), F.col(output).alias("output")).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("case").orderBy(F.desc("n"), "output")
    marked = counts.withColumn("__first", F.row_number().over(best) == 1)
    out = marked.groupBy("case").agg(
        F.sum("n").alias("repetitions"), F.count(F.lit(1)).alias("distinct_outputs"), F.max(F.when(F.col("__first"), F.col("output"))).alias("modal_output"), (F.max("n") / F.sum("n")).alias("modal_share")
    )
    stability = (
        F.when(F.col("distinct_outputs") == 1, "DETERMINISTIC").when(F.col("modal_share") >= near, "NEAR_DETERMINISTIC").when(F.col("modal_share") >= unstable, "UNSTABLE").otherwise("NON_DETERMINISTIC")
    )
    return out.withColumn("stability", stability).withColumn("passes", stability.isin("DETERMINISTIC", "NEAR_DETERMINISTIC"))


#: What each class of stability and drift counts in a fidelity score.
STABILITY_WEIGHT = {"DETERMINISTIC": 1.0, "NEAR_DETERMINISTIC": 0.85, "UNSTABLE": 0.45, "NON_DETERMINISTIC": 0.0}
DRIFT_WEIGHT = {"STABLE": 1.0, "MODERATE": 0.6, "SIGNIFICANT": 0.0}


def fidelity(cases: DataFrame, drift: DataFrame, warn: float = 0.90, block: float = 0.70) -> DataFrame:
    """score, gate, determinism_score, drift_score, findings: 0.6 and 0.4 of both means, or the one there is."""
    weight = lambda table, c: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()))
    a = cases.agg(F.avg(weight(STABILITY_WEIGHT, F.col("stability"))).alias("d"), F.array_sort(F.collect_list(F.when(~F.col("passes"), F.format_string("%s: %s, modal share %.2f", "case", "stability", "modal_share")))).alias("fd"))
    b = drift.agg(F.avg(weight(DRIFT_WEIGHT, F.col("severity"))).alias("s"), F.array_sort(F.collect_list(F.when(F.col("severity") != "STABLE", F.format_string("%s: %s drift, %.4f", "feature", "severity", "statistic")))).alias("fs"))
    score = F.coalesce(0.6 * F.col("d") + 0.4 * F.col("s"), F.col("d"), F.col("s"), F.raise_error(F.lit("fidelity needs a determinism or a drift report")).cast("double"))
    gate = F.when(score < block, "BLOCK").when(score < warn, "WARN").otherwise("PASS")
    return a.crossJoin(b).select(score.alias("score"), gate.alias("gate"), F.coalesce("d", F.lit(1.0)).alias("determinism_score"), F.coalesce("s", F.lit(1.0)).alias("drift_score"), F.concat("fd", "fs").alias("findings"))

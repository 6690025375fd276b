"""Workforce projection in closed form, hiring needs, skill gaps and role matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpforge.functions.numeric import proficiency
from kelpforge.functions.text import skill_tokens

SCENARIO = "name string, headcount long, attrition double, hires long, ramp int, demand double"


def project(scenarios: DataFrame, months: int = 12, digits: int = 3) -> DataFrame:
    """name, month, headcount, effective_capacity, leavers, joiners, demand, shortfall for each scenario and month.

    With retention r, a hire of month s is there in month t with weight r^(t-s), so headcount is h0 r^t + hires * sum of
    the r^k with k < t, and cohorts younger than the ramp work at k / ramp. No month depends on another row.
    """
    if months <= 0:
        raise ValueError("a projection covers at least one month")
    t, r = F.col("month"), 1 - F.col("attrition")
    power = lambda k: F.when(k == 0, F.lit(1.0)).otherwise(F.pow(r, k))
    cohorts = lambda n, weight: F.aggregate(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: power(k) * weight(k)), F.lit(0.0), lambda a, x: a + x)
    heads = lambda n: F.col("headcount") * power(n) + F.col("hires") * cohorts(n, lambda k: F.lit(1.0))
    grid = scenarios.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))
    young = F.least(t, F.col("ramp"))
    idle = F.col("hires") * cohorts(young, lambda k: 1 - k / F.col("ramp"))
    total = heads(t)
    out = grid.select(
        "name", "month", F.round(total, digits).alias("h"), F.round(F.greatest(total - idle, F.lit(0.0)), digits).alias("effective_capacity"),
        F.round(heads(t - 1) * F.col("attrition"), digits).alias("leavers"), F.col("hires").alias("joiners"), "demand",
    )
    return out.withColumnRenamed("h", "headcount").withColumn("shortfall", F.greatest(F.lit(0.0), F.col("demand") - F.col("effective_capacity")))


def projection_summary(states: DataFrame) -> DataFrame:
    out = states.groupBy("name").agg(
        F.max_by("headcount", "month").alias("final_headcount"), F.sum("leavers").alias("total_leavers"), F.sum("joiners").alias("total_hires"),
        F.min(F.when(F.col("shortfall") > 0, F.col("month"))).alias("first_shortfall_month"), F.max("shortfall").alias("peak_shortfall"),
        F.max_by("month", F.struct("shortfall", -F.col("month"))).alias("peak_month"),
    )
    holds = F.format_string("%s: capacity holds, %.1f heads at the end", "name", "final_headcount")
    short = F.format_string("%s: short from month %d, at most by %.1f", "name", "first_shortfall_month", "peak_shortfall")
    return out.withColumn("summary", F.when(F.col("first_shortfall_month").isNull(), holds).otherwise(short))


def hires_required(targets: DataFrame, months: int = 12) -> DataFrame:
    """name, target, hires: the smallest monthly hiring whose final headcount, to 3 decimals, reaches target; null if none up to target + headcount does."""
    r = 1 - F.col("attrition")
    per_hire = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.pow(r, k)), F.lit(0.0), lambda a, x: a + x)
    final = lambda n: F.round(F.col("headcount") * F.pow(r, F.lit(months)) + n * per_hire, 3)
    # The final headcount grows with hires in a line, so the answer lies next to its solution.
    guess = F.ceil((F.col("target") - F.col("headcount") * F.pow(r, F.lit(months))) / per_hire)
    near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.greatest(F.lit(0), guess + d))
    best = F.array_min(F.filter(near, lambda n: final(n) >= F.col("target")))
    return targets.select("name", "target", F.when(best <= F.col("target") + F.col("headcount"), best).cast("long").alias("hires"))


def skill_holdings(evidence: DataFrame, aliases: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """subject, skill, mentions, years, level. evidence is (subject, text), aliases (alias, skill), years (subject, skill, years)."""
    told = evidence.select("subject", F.explode(skill_tokens(F.col("text"))).alias("alias"))
    counts = told.join(aliases.select(F.lower("alias").alias("alias"), "skill"), "alias").groupBy("subject", "skill").agg(F.count(F.lit(1)).alias("mentions"))
    joined = counts.withColumn("years", F.lit(0.0)) if years is None else counts.join(years, ["subject", "skill"], "left").fillna(0.0, ["years"])
    return joined.withColumn("level", proficiency(F.col("mentions"), F.col("years")))


def duplicate_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy(F.lower("alias").alias("alias")).agg(F.countDistinct("skill").alias("skills")).where("skills > 1")


def with_family(holdings: DataFrame, families: DataFrame) -> DataFrame:
    """Adds the skill's family; an unknown skill is refused."""
    joined = holdings.join(families, "skill", "left")
    return joined.withColumn("family", F.coalesce("family", F.raise_error(F.concat(F.lit("unknown skill "), F.col("skill"))).cast("string")))


def gap_forecast(holdings: DataFrame, requirements: DataFrame, attrition: float = 0.0) -> DataFrame:
    """skill, required, supply, demand, shortfall. requirements is (skill, required level, demand); supply is cut, not rounded."""
    if not 0 <= attrition < 1:
        raise ValueError("attrition must be in [0, 1)")
    held = requirements.join(holdings.select("skill", "subject", "level"), "skill", "left")
    sums = held.groupBy("skill", "required", "demand").agg(F.countDistinct(F.when(F.col("level") >= F.col("required"), F.col("subject"))).alias("n"))
    supply = F.floor(F.col("n") * (1.0 - attrition)).cast("long")
    return sums.select("skill", "required", supply.alias("supply"), "demand", F.greatest(F.lit(0).cast("long"), F.col("demand") - supply).alias("shortfall"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.sum("shortfall").alias("total"), F.max_by("skill", F.struct("shortfall", "skill")).alias("worst")).withColumn("summary", F.format_string("%d positions short, most in %s", "total", "worst"))


def match_roles(holdings: DataFrame, requirements: DataFrame, families: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """subject, role, score, ready_now, stretch, satisfied, missing (ordered by levels short).

    requirements is (role, family, skill, required). A missing skill is level 0. Knowing any skill of the role's family
    adds 0.05, up to 1. Subjects meet only roles that ask for a skill of theirs or share a family; others score 0 and
    are returned by nobody, as with least above 0.
    """
    touch = holdings.join(requirements.select("role", "skill"), "skill").select("subject", "role")
    near = None
    if families is not None:
        own = holdings.where("level > 0").join(families, "skill").select("subject", "family").distinct()
        near = own.join(requirements.select("role", "family").distinct(), "family").select("subject", "role").distinct()
        touch = touch.union(near)
    asked = touch.distinct().join(requirements, "role").join(holdings.select("subject", "skill", "level"), ["subject", "skill"], "left").fillna(0, ["level"])
    short = F.col("required") - F.col("level")
    delta = F.struct(short.alias("short"), F.col("skill").alias("skill"), F.col("level").alias("level"), F.col("required").alias("required"))
    sums = asked.groupBy("subject", "role").agg(
        F.sum(F.least("level", "required")).alias("earned"), F.sum("required").alias("available"), F.max(short).alias("most"),
        F.array_sort(F.collect_list(F.when(short <= 0, F.col("skill")))).alias("satisfied"), F.array_sort(F.collect_list(F.when(short > 0, delta))).alias("missing"),
    )
    base = F.when(F.col("available") > 0, F.col("earned") / F.col("available")).otherwise(0.0)
    bonus = F.lit(0.0)
    if near is not None:
        sums = sums.join(near.withColumn("bonus", F.lit(0.05)), ["subject", "role"], "left")
        bonus = F.coalesce("bonus", F.lit(0.0))
    score = F.bround(F.least(F.lit(1.0), base + bonus), 4)
    out = sums.select("subject", "role", score.alias("score"), (F.col("most") <= 0).alias("ready_now"), (F.col("most") == 1).alias("stretch"), "satisfied", F.transform("missing", lambda d: F.format_string("%s: %d to %d", d["skill"], d["level"], d["required"])).alias("missing"))
    return out.where(F.col("score") >= least)


def ranked_roles(matches: DataFrame, least: float = 0.5) -> DataFrame:
    own = Window.partitionBy("subject").orderBy(F.desc("ready_now"), F.desc("score"), "role")
    return matches.where(F.col("score") >= least).withColumn("rank", F.row_number().over(own))


def ranked_candidates(matches: DataFrame, least: float = 0.6) -> DataFrame:
    own = Window.partitionBy("role").orderBy(F.desc("score"), "subject")
    return matches.where(F.col("score") >= least).withColumn("rank", F.row_number().over(own))


def attrition_features(df: DataFrame) -> DataFrame:
    """subject_key, 8 copied numbers and salary over band midpoint and over peer median; defaults: engagement 3, others 0."""
    refuse = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) <= 0, F.raise_error(F.lit(f"{c} must be positive")).cast("double")).otherwise(F.col(c))
    number = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c)
    copied = ["tenure_years", "months_since_promotion", "manager_changes_24m", "commute_minutes", "training_hours_12m", "overtime_hours_monthly", "internal_applications_12m"]
    return df.select(
        "subject_key", *(number(c) for c in copied), number("engagement_score", 3.0),
        (F.col("salary") / refuse("band_midpoint")).alias("compensation_ratio_to_band"), (F.col("salary") / refuse("peer_median_salary")).alias("compensation_ratio_to_peers"),
    )


def top_drivers(values: dict[str, Column], means: dict[str, float], importance: dict[str, float], limit: int = 3) -> Column:
    """Array of (feature, contribution, direction): |x - mean| / |mean| times the importance, zeros left out, largest first."""
    told = []
    for f, x in values.items():
        spread = abs(means[f]) if abs(means[f]) > 1e-9 else 1.0
        gap = (x - F.lit(means[f])) / F.lit(spread)
        told.append(F.struct(F.round(-F.abs(gap) * F.lit(importance[f]), 12).alias("key"), F.lit(f).alias("feature"), F.bround(F.abs(gap) * F.lit(importance[f]), 4).alias("contribution"), F.when(gap > 0, "above cohort").otherwise("below cohort").alias("direction")))
    kept = F.filter(F.array_sort(F.array(*told)), lambda s: s["key"] < 0)
    return F.transform(F.slice(kept, 1, limit), lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution"), s["direction"].alias("direction")))


def scenario_comparison(scenarios: Sequence[tuple], spark, months: int = 12) -> DataFrame:
    return projection_summary(project(spark.createDataFrame(list(scenarios), SCENARIO), months))

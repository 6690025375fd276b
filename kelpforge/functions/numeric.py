"""Numeric columns: bands, decay, vectors, calibration maps, test statistics and their tails."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def banded(value: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """The label of the first lower bound (given from the top) that value reaches; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(value >= bound, F.lit(label))
    return out.otherwise(F.lit(below))


def risk_band(p: Column) -> Column:
    return banded(p, [(0.60, "HIGH"), (0.30, "MEDIUM")], "LOW")


def recommendation(score: Column) -> Column:
    return banded(score, [(0.75, "ADVANCE"), (0.45, "REVIEW")], "HOLD")


def age_band(age: Column) -> Column:
    return banded(age, [(45, "45_plus"), (30, "30_to_44")], "under_30")


def drift_severity(statistic: Column, moderate: float = 0.10, significant: float = 0.25, labels: Sequence[str] = ("STABLE", "MODERATE", "SIGNIFICANT")) -> Column:
    return banded(statistic, [(significant, labels[2]), (moderate, labels[1])], labels[0])


def proficiency(mentions: Column, years: Column) -> Column:
    """0 none, 1 awareness, 2 working, 3 practitioner, 4 expert."""
    return (
        F.when(mentions <= 0, 0).when((years >= 5) & (mentions >= 2), 4).when(years >= 3, 3).when(years >= 1, 2).otherwise(1).cast("int")
    )


def half_life_decay(age_seconds: Column, half_life_seconds: float) -> Column:
    return F.when(age_seconds <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age_seconds / half_life_seconds))


def fresh_score(score: Column, age_seconds: Column, half_life_seconds: float, weight: float) -> Column:
    """(1 - weight) * score + weight * score * decay; without an age the score stands."""
    return F.when(age_seconds.isNull(), score).otherwise((1 - weight) * score + weight * score * half_life_decay(age_seconds, half_life_seconds))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.log(q / (1 - q))


def platt(score: Column, slope: float, intercept: float) -> Column:
    return sigmoid(slope * logit(score) + intercept)


def python_round(x: Column, digits: int) -> Column:
    """Half to even, on the shortest decimal form of the value."""
    return F.bround(x, digits)


def chi_squared_tail(statistic: float, dof: float) -> float:
    """P(X >= statistic): the regularised upper incomplete gamma function Q(dof / 2, statistic / 2)."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series for the lower function
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300  # continued fraction for the upper function
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return min(1.0, scale * h)


def chi_squared_p(statistic: Column, dof: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def tail(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else chi_squared_tail(float(a), float(b)) for a, b in zip(s, k, strict=True)], dtype=float)

    return tail(statistic.cast("double"), dof.cast("double"))


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample tail (Kolmogorov's series with Stephens' correction); within [0, 1]."""
    size = F.sqrt(n * m / (n + m))
    x = (size + 0.12 + 0.11 / size) * statistic
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


#: Rows of the larger sample up to which the two-sample distribution is counted exactly.
EXACT_ROWS = 10_000


def two_sample_tail(statistic: float, n: int, m: int) -> float:
    """P(D >= statistic) for two samples of n and m rows without ties, by counting lattice paths.

    A path from (0, 0) to (n, m) is an order of both samples; D is its largest gap |i / n - j / m|, a multiple of
    1 / lcm(n, m). Paths that stay below the statistic are counted row by row: those through (i, j) came from (i - 1, j) or
    (i, j - 1), so a row is a running sum over the j that the bound allows. Rows are scaled, since counts outgrow floats.
    """
    whole = n * m // math.gcd(n, m)
    reach = round(statistic * whole)  # gaps are compared as whole numbers
    if abs(statistic * whole - reach) > 1e-6 * max(1.0, whole * 1e-6):
        reach = math.ceil(statistic * whole)
    if reach <= 0:
        return 1.0
    a, b = whole // n, whole // m
    j = np.arange(m + 1)
    ways, scale = (j * b < reach).astype(float), 0.0
    for i in range(1, n + 1):
        ways = np.cumsum(np.where(np.abs(i * a - j * b) < reach, ways, 0.0))
        ways = np.where(np.abs(i * a - j * b) < reach, ways, 0.0)
        top = ways.max()
        if top == 0:
            return 1.0
        ways, scale = ways / top, scale + math.log(top)
    if ways[m] == 0:
        return 1.0
    below = math.log(ways[m]) + scale - (math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1))
    return min(1.0, max(0.0, -math.expm1(min(0.0, below))))


def two_sample_p(statistic: Column, n: Column, m: Column, exact_rows: int = EXACT_ROWS) -> Column:
    """The exact tail where neither sample has more than exact_rows rows, else the asymptotic one."""

    @F.pandas_udf(T.DoubleType())
    def tail(s: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(d) else two_sample_tail(float(d), int(a), int(b)) for d, a, b in zip(s, n, m, strict=True)], dtype=float)

    small = (F.greatest(n, m) <= exact_rows) & (F.least(n, m) > 0)
    return F.when(small, tail(F.when(small, statistic), F.when(small, n).otherwise(1), F.when(small, m).otherwise(1))).otherwise(kolmogorov_p(statistic, n, m))

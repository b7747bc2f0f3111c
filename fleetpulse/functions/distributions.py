"""p-values of the test statistics.

They run on report rows (one per tested column), never on readings. The
Kolmogorov series is a plain expression; the lattice paths and the two incomplete
functions, which SQL has no form for, are small vectorised helpers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


#: Up to so many rows in the larger sample the Kolmogorov-Smirnov p-value is exact.
EXACT_ROWS = 10_000


def ks_exact(statistic: float, n1: int, n2: int) -> float:
    """Exact two-sided p-value of the Kolmogorov-Smirnov statistic of two samples without ties.

    The order of the joint sample is a path over a lattice, all paths being equally
    likely; the statistic is reached if the path leaves a band around the diagonal. The chances
    of the places inside the band are carried on step by step, and what steps out of it adds up to
    the p-value, so small values lose nothing to cancellation.
    """
    m, n = int(n1), int(n2)
    reach = round(statistic * m * n)  # inside: |i n - j m| < reach
    if reach <= 0:
        return 1.0
    chance, out = np.ones(1), 0.0
    first = 0  # the number of the first sample's rows at chance[0]
    for k in range(m + n):
        i = np.arange(first, first + len(chance))
        up = chance * (m - i) / (m + n - k)
        right = chance * (n - (k - i)) / (m + n - k)
        after = np.append(right, 0.0)
        after[1:] += up
        i = np.append(i, first + len(chance))
        inside = np.abs(i * n - (k + 1 - i) * m) < reach
        out += float(after[~inside].sum())
        if not inside.any():
            break
        places = np.flatnonzero(inside)
        chance, first = after[places[0] : places[-1] + 1], int(i[places[0]])
    return min(1.0, out)


def ks_p_value(statistic: Column, n1: Column, n2: Column, exact_rows: int = EXACT_ROWS) -> Column:
    """Two-sided Kolmogorov-Smirnov p-value: exact up to ``exact_rows`` rows in the larger sample, asymptotic above."""
    if not exact_rows:
        return ks_asymptotic(statistic, n1, n2)

    @pandas_udf("double")
    def exact(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or not y or not z else ks_exact(x, y, z) for x, y, z in zip(d, a, b)], dtype="float64")

    few = (F.greatest(n1, n2) <= exact_rows) & (F.least(n1, n2) > 0)
    # Python only sees the rows that need it
    found = exact(F.when(few, statistic).cast("double"), F.when(few, n1).otherwise(0), F.when(few, n2).otherwise(0))
    return F.when(few, found).otherwise(ks_asymptotic(statistic, n1, n2))


def ks_asymptotic(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value."""
    lam2 = statistic * statistic * (n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.greatest(F.lit(-2.0) * k * k * lam2, F.lit(-700.0))),
    )
    # The alternating series needs many terms near zero, where the value is one.
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series))
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if t is None or dof is None or math.isnan(t) or not dof > 0:
        return float("nan")
    if dof > 1e6:
        return math.erfc(abs(t) / math.sqrt(2.0))
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def chi2_upper(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x is None or dof is None or math.isnan(x) or not dof > 0:
        return float("nan")
    a, z = dof / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def _per_row(function):
    @pandas_udf("double")
    def rows(stat: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([function(s, d) for s, d in zip(stat, dof)], dtype="float64")

    return rows


def t_p_value(t: Column, dof: Column) -> Column:
    return _per_row(t_two_sided)(t.cast("double"), dof.cast("double"))


def chi2_p_value(statistic: Column, dof: Column) -> Column:
    return _per_row(chi2_upper)(statistic.cast("double"), dof.cast("double"))

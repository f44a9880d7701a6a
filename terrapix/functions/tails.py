"""Tail probabilities of Student's t and of chi squared, for tables of class pairs: a few rows, so a small Python helper."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or tiny), 1 + num / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, d = x + 1 - a, 1 / (x + 1 - a)
    c, out = 1e300, d
    for k in range(1, 1000):
        b += 2
        d, c = 1 / (b - k * (k - a) * d), b - k * (k - a) / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Probability of a |t| at least as large; null where t or df is. Meant for test results: a row for each pair of classes."""
    return pd.Series([None if pd.isna(a) or pd.isna(v) else beta_tail(v / 2, 0.5, v / (v + a * a)) for a, v in zip(t, df)], dtype="float64")


@pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """Probability of a chi squared at least as large; null where x or df is. Meant for test results, of a row each."""
    return pd.Series([None if pd.isna(a) or pd.isna(v) else gamma_tail(v / 2, a / 2) for a, v in zip(x, df)], dtype="float64")

"""Tail probabilities Spark has no function for.

They are evaluated on a handful of rows (one per column or per pair of
columns), never on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, Lentz's method."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 2000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float | None, n: int | None) -> float | None:
    """Two-sided p of Pearson's r on n rows; 1 when two rows or fewer."""
    if n is None or n <= 2:
        return 1.0
    if r is None or math.isnan(r):
        return None
    if abs(r) >= 1.0:
        return 0.0
    # x = df / (df + t^2) with t = r * sqrt(df / (1 - r^2)) is 1 - r^2.
    return incomplete_beta((n - 2) / 2.0, 0.5, 1.0 - r * r)


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    pairs = zip(r, n)
    return pd.Series(
        [correlation_p(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b)) for a, b in pairs],
        dtype="float64",
    )

"""Numeric expressions and the labels given by cut points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std, 0 where std is not above 0."""
    return F.when(std > 0, (value - mean) / std).otherwise(F.lit(0.0))


def bin_label(low: Column, high: Column) -> Column:
    return F.format_string("%.2f-%.2f", low, high)


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present; null for a constant column.

    The built-in ``corr`` raises on a constant column under ANSI rules, and the
    two deviations must see the same rows as the covariance.
    """
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(
        F.covar_samp(x, y),
        real_deviation(F.stddev_samp(F.when(both, x)), x) * real_deviation(F.stddev_samp(F.when(both, y)), y),
    )


def real_deviation(deviation: Column, value: Column) -> Column:
    """Null for a deviation that is only rounding noise at the size of the values.

    Partial results of a constant column merge to something like 1e-17, not 0.
    """
    size = F.greatest(F.abs(F.min(value)), F.abs(F.max(value)))
    return F.when(deviation > size * 1e-12, deviation)


def by_cuts(value: Column, cuts: list[tuple[str, float, str]], otherwise: str) -> Column:
    """First label whose comparison holds; null for a null value."""
    compare = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__}
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for op, bound, name in cuts:
        label = label.when(compare[op](F.lit(bound)), name)
    return label.otherwise(otherwise)


def pair_strength(r: Column) -> Column:
    """Bands of the distribution statistics: a bound belongs to the band above it."""
    cuts = [("<", 0.3, "Very Weak"), ("<", 0.5, "Weak"), ("<", 0.7, "Moderate"), ("<", 0.9, "Strong")]
    return by_cuts(F.abs(r), cuts, "Very Strong")


def matrix_strength(r: Column) -> Column:
    """Bands of the correlation matrix: a bound belongs to the band below it."""
    cuts = [(">", 0.9, "Very Strong"), (">", 0.7, "Strong"), (">", 0.5, "Moderate"), (">", 0.3, "Weak")]
    return by_cuts(F.abs(r), cuts, "Very Weak")


def vif_severity(vif: Column) -> Column:
    return by_cuts(vif, [(">", 10.0, "CRITICAL"), (">", 5.0, "WARNING")], "OK")


def confidence_band(confidence: Column) -> Column:
    return by_cuts(confidence, [(">=", 0.85, "high"), (">=", 0.65, "moderate")], "low")


def gap_status(gap: Column) -> Column:
    return by_cuts(gap, [("<", 0.03, "acceptable"), ("<", 0.08, "moderate")], "overfitting")


def target_strength(r: Column) -> Column:
    cuts = [(">", 0.5, "strong"), (">", 0.3, "moderate"), (">", 0.1, "weak")]
    return by_cuts(F.abs(r), cuts, "negligible")


def skew_type(skew: Column) -> Column:
    return (
        F.when(F.abs(skew) < 0.5, "Approximately Symmetric")
        .when(skew > 0, "Right-skewed (Positive skew)")
        .when(skew < 0, "Left-skewed (Negative skew)")
    )


def tail_type(kurtosis: Column) -> Column:
    return (
        F.when(F.abs(kurtosis) < 0.5, "Mesokurtic (normal-like)")
        .when(kurtosis > 0, "Leptokurtic (heavy tails)")
        .when(kurtosis < 0, "Platykurtic (light tails)")
    )


def key_number(key: Column, seed: int | str) -> Column:
    """A number in [0, 2^32) fixed by the seed and the key's text, by md5."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

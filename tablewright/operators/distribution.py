"""Distribution statistics: shape, histograms, outliers, categories, normality."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.numbers import bin_label, skew_type, tail_type
from ..functions.tails import normal_tail
from ..plans.schema import columns_by_kind, numeric_cells, numeric_columns
from .profile import _value_counts_text, moments
from .ranking import column_quantiles, running


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skewness and kurtosis with their types, range and coefficient of variation.

    Columns with fewer than two values are left out; a constant one has null
    shape.
    """
    cv = F.when(F.col("mean") != 0, F.col("std_pop") / F.col("mean") * 100).otherwise(F.lit(0.0))
    return moments(df, columns).filter("n >= 2").select(
        "column", "skewness", "kurtosis", skew_type(F.col("skewness")).alias("distribution_type"),
        tail_type(F.col("kurtosis")).alias("kurtosis_type"), (F.col("max") - F.col("min")).alias("value_range"),
        cv.alias("coefficient_of_variation"),
    )


def categorical_distributions(df: DataFrame, top_n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``top_n`` values of each text column, null counted as a value.

    Rows: column, unique_values, total_rows, missing_count, rank, value, count,
    percentage (of all rows).  Counting is a two-phase aggregate; the rank
    filter is a group limit, so a task sends at most ``top_n`` rows per column.
    """
    names = list(columns) if columns is not None else columns_by_kind(df)["categorical"]
    counts = _value_counts_text(df, names)
    totals = counts.groupBy(F.col("column").alias("_c")).agg(
        F.count("value").alias("unique_values"), F.sum("n").alias("total_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
    )
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    # One row per column, so the broadcast is bounded by the schema.
    return top.join(F.broadcast(totals), F.col("column") == F.col("_c")).select(
        "column", "unique_values", "total_rows", "missing_count", "rank", "value", F.col("n").alias("count"),
        (F.col("n") / F.col("total_rows") * 100).alias("percentage"),
    )


def _edges(low, high, bins: int, i):
    """Edge i of ``bins`` equal bins; a constant column gets half a unit each side."""
    lo = F.when(high > low, low).otherwise(low - 0.5)
    hi = F.when(high > low, high).otherwise(high + 0.5)
    return F.when(i >= bins, hi).otherwise(lo + i * ((hi - lo) / bins))


def histograms(df: DataFrame, bins: int = 15, columns: Sequence[str] | None = None) -> DataFrame:
    """Equal-width bins per numeric column, empty bins included; the last bin is closed.

    Rows: column, bin, low, high, label, frequency.  The bounds are one row per
    column and broadcast; frequencies are one map-side combined aggregate.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    cells = numeric_cells(df, names)
    bounds = cells.groupBy(F.col("column").alias("_c")).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    placed = cells.join(F.broadcast(bounds), F.col("column") == F.col("_c"))
    start = _edges(lo, hi, bins, F.lit(0))
    width = _edges(lo, hi, bins, F.lit(bins)) - start
    guess = F.least(F.floor((F.col("value") - start) * (F.lit(float(bins)) / width)), F.lit(bins - 1)).cast("int")
    # The division may land one bin off at an edge; the edges themselves decide.
    placed = placed.withColumn("_g", guess)
    g = F.col("_g")
    exact = (
        g - F.when(F.col("value") < _edges(lo, hi, bins, g), 1).otherwise(0)
        + F.when((F.col("value") >= _edges(lo, hi, bins, g + 1)) & (g < bins - 1), 1).otherwise(0)
    )
    counted = placed.groupBy("column", exact.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    frame = bounds.select(
        F.col("_c").alias("column"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi"
    ).withColumn("low", _edges(lo, hi, bins, F.col("bin"))).withColumn("high", _edges(lo, hi, bins, F.col("bin") + 1))
    return frame.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "low", "high", bin_label(F.col("low"), F.col("high")).alias("label"),
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
    )


def histogram_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The statistics shown beside each histogram (population std, quartiles, missing)."""
    names = list(columns) if columns is not None else numeric_columns(df)
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    quantiles = column_quantiles(df, {"q1": 0.25, "median": 0.5, "q3": 0.75}, names)
    return moments(df, names).join(F.broadcast(quantiles), "column").select(
        "column", "mean", "median", F.col("std_pop").alias("std"), "min", "max", "q1", "q3",
        rows.scalar().alias("total_count"), (rows.scalar() - F.col("n")).alias("missing_count"),
    )


def outlier_bounds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartile fences per numeric column with at least four values."""
    names = list(columns) if columns is not None else numeric_columns(df)
    cells = numeric_cells(df, names)
    quantiles = column_quantiles(df, {"q1": 0.25, "median": 0.5, "q3": 0.75}, names)
    sizes = cells.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    iqr = F.col("q3") - F.col("q1")
    return sizes.filter("n >= 4").join(F.broadcast(quantiles), "column").select(
        "column", "n", "mean", "median", "q1", "q3", iqr.alias("iqr"),
        (F.col("q1") - 1.5 * iqr).alias("lower_bound"), (F.col("q3") + 1.5 * iqr).alias("upper_bound"),
    )


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: fences, number, share and extremes of values outside them."""
    names = list(columns) if columns is not None else numeric_columns(df)
    bounds = outlier_bounds(df, names)
    v = F.col("value")
    far = (v < F.col("lower_bound")) | (v > F.col("upper_bound"))
    keys = ["column", "n", "mean", "median", "q1", "q3", "iqr", "lower_bound", "upper_bound"]
    return numeric_cells(df, names).join(F.broadcast(bounds), "column").groupBy(*keys).agg(
        F.count_if(far).alias("outlier_count"), F.min(F.when(far, v)).alias("min_outlier"),
        F.max(F.when(far, v)).alias("max_outlier"),
    ).withColumn("outlier_percentage", F.col("outlier_count") / F.col("n") * 100)


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose value lies outside the fences (a table, not a list of positions)."""
    bounds = outlier_bounds(df, [column]).select(F.struct("lower_bound", "upper_bound").alias("b"))
    fence, value = bounds.scalar(), col(column).cast("double")
    return df.filter((value < fence["lower_bound"]) | (value > fence["upper_bound"]))


# Royston's 1995 polynomials for the Shapiro-Wilk test, lowest power first.
_LAST = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
_NEXT_TO_LAST = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_SMALL_BOUND = [-2.273, 0.459]
_SMALL_MEAN = [0.544, -0.39978, 0.025054, -0.0006714]
_SMALL_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
_LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
_LARGE_SD = [-0.4803, -0.082676, 0.0030302]

_CHUNK = 10_000


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _poly(coefficients: list[float], x: float) -> float:
    return sum(c * x ** i for i, c in enumerate(coefficients))


def _score(rank: float, n: int) -> float:
    """Expected normal score of a 1-based rank."""
    return NormalDist().inv_cdf((rank - 0.375) / (n + 0.25))


def shapiro_from_sums(n: int, squares: float, products: float, scores_squared: float,
                      lowest: tuple[float, float], highest: tuple[float, float]) -> tuple[float, float]:
    """W and p from sums over the centred, ordered sample.

    ``products`` is the sum of score times value and ``scores_squared`` the sum
    of squared scores; ``lowest`` and ``highest`` hold the two extreme values,
    outermost first.
    """
    spread = highest[0] - lowest[0]
    if n < 3 or spread <= 0 or squares <= 0:
        return float("nan"), float("nan")
    if n == 3:
        top = math.sqrt(0.5) * spread
        w = min(top * top / squares, 1.0)
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    m_last, u = _score(n, n), 1.0 / math.sqrt(n)
    a_last = m_last / math.sqrt(scores_squared) + _poly(_LAST, u)
    if n > 5:
        m_next = _score(n - 1, n)
        a_next = m_next / math.sqrt(scores_squared) + _poly(_NEXT_TO_LAST, u)
        scale = (scores_squared - 2 * m_last ** 2 - 2 * m_next ** 2) / (1 - 2 * a_last ** 2 - 2 * a_next ** 2)
        inner = products - m_last * spread - m_next * (highest[1] - lowest[1])
        top = a_last * spread + a_next * (highest[1] - lowest[1]) + inner / math.sqrt(scale)
    else:
        scale = (scores_squared - 2 * m_last ** 2) / (1 - 2 * a_last ** 2)
        top = a_last * spread + (products - m_last * spread) / math.sqrt(scale)
    w = min(top * top / squares, 1.0)
    if w >= 1.0:
        return 1.0, 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        bound = _poly(_SMALL_BOUND, n)
        if y >= bound:
            return w, 1e-99
        return w, normal_tail((-math.log(bound - y) - _poly(_SMALL_MEAN, n)) / math.exp(_poly(_SMALL_SD, n)))
    x = math.log(n)
    return w, normal_tail((y - _poly(_LARGE_MEAN, x)) / math.exp(_poly(_LARGE_SD, x)))


def normal_scores(shares: np.ndarray, run: int = 32) -> np.ndarray:
    """Inverse normal of sorted runs of shares: exact at one share in ``run``, a series around it for the rest.

    The series is the quantile function's own (its slope is 1 over the density);
    five terms leave less than 1e-9 while a step is under a hundredth of the
    slope's scale.  Shares further from their node, in the tails or in short
    columns, are computed one by one.
    """
    inverse = NormalDist().inv_cdf
    node = np.minimum(np.arange(len(shares)) // run * run + run // 2, len(shares) - 1)
    places, back = np.unique(node, return_inverse=True)
    x = np.array([inverse(s) for s in shares[places].tolist()])[back]
    u = (shares - shares[node]) * np.sqrt(2 * np.pi) * np.exp(x * x / 2)
    terms = (1.0, x / 2, (2 * x**2 + 1) / 6, (6 * x**3 + 7 * x) / 24, (24 * x**4 + 46 * x**2 + 7) / 120)
    out = x + sum(c * u ** (i + 1) for i, c in enumerate(terms))
    far = np.flatnonzero(np.abs(u) > 0.01)
    out[far] = [inverse(s) for s in shares[far].tolist()]
    return out


@F.pandas_udf(_doubles("m", "m2"))
def _score_sums(start: pd.Series, length: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Sum and squared sum of normal scores over ranks start+1 .. start+length."""
    k = length.to_numpy()
    if not len(k):
        return pd.DataFrame({"m": [], "m2": []}, dtype="float64")
    begins = np.concatenate([[0], np.cumsum(k)[:-1]])
    ranks = np.arange(k.sum()) - np.repeat(begins, k) + np.repeat(start.to_numpy(), k) + 1
    scores = normal_scores((ranks - 0.375) / (np.repeat(size.to_numpy(), k) + 0.25))
    return pd.DataFrame({"m": np.add.reduceat(scores, begins), "m2": np.add.reduceat(scores * scores, begins)})


@F.pandas_udf(_doubles("w", "p"))
def _shapiro_rows(n: pd.Series, squares: pd.Series, products: pd.Series, m2: pd.Series, x1: pd.Series,
                  x2: pd.Series, y2: pd.Series, y1: pd.Series) -> pd.DataFrame:
    rows = [
        shapiro_from_sums(int(a), b, c, d, (e, f), (h, g))
        for a, b, c, d, e, f, g, h in zip(n, squares, products, m2, x1, x2, y2, y1)
    ]
    return pd.DataFrame(rows, columns=["w", "p"])


def shapiro_wilk(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shapiro-Wilk W and p per numeric column, on every value.

    The test needs each value's rank, and its weights are one inverse normal
    per rank.  Values are counted, ranked with ``running`` (no column is held in
    one task) and ties are cut into chunks of ranks, so a value that fills a
    third of the table is spread over tasks as well.  Only the sums per column
    meet in the closing formula.
    """
    cells = numeric_cells(df, None if columns is None else list(columns))
    sizes = cells.groupBy(F.col("column").alias("_c")).agg(
        F.count("value").alias("_size"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"))
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counted, ["column"], ["value"], sums={"_upto": F.col("_n")})
    # One row per column, so the broadcast is bounded by the schema.
    rows = ranked.join(F.broadcast(sizes), F.col("column") == F.col("_c")).withColumn(
        "_from", F.col("_upto") - F.col("_n"))
    chunks = rows.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / _CHUNK)))
    ).withColumn("_start", F.col("_from") + F.col("_chunk") * _CHUNK).withColumn(
        "_length", F.least(F.lit(_CHUNK).cast("bigint"), F.col("_upto") - F.col("_start")))
    scored = chunks.repartition(F.col("column"), F.col("value"), F.col("_chunk")).withColumn(
        "_s", _score_sums("_start", "_length", "_size"))
    centred = F.col("value") - F.col("_mean")

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_length")), centred))

    last = F.col("_size") - 1
    sums = scored.groupBy("column", "_size", "_var").agg(
        F.sum(centred * F.col("_s.m")).alias("products"), F.sum("_s.m2").alias("m2"),
        at(F.lit(0)).alias("x1"), at(F.lit(1)).alias("x2"), at(last - 1).alias("y2"), at(last).alias("y1"),
    )
    return sums.filter("_size >= 3").select(
        "column", F.col("_size").alias("sample_size"),
        _shapiro_rows("_size", F.col("_var") * F.col("_size"), "products", "m2", "x1", "x2", "y2", "y1").alias("_r"),
    ).select("column", "sample_size", F.col("_r.w").alias("statistic"), F.col("_r.p").alias("p_value"))


def normality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shapiro-Wilk with skewness, excess kurtosis and Jarque-Bera, per numeric column."""
    shape = moments(df, columns)
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return shapiro_wilk(df, columns).join(F.broadcast(shape), "column").select(
        "column", F.lit("Shapiro-Wilk").alias("test"), "statistic", "p_value",
        (F.col("p_value") > 0.05).cast("int").alias("is_normal"),
        F.when(F.col("p_value") > 0.05, "Approximately normal").otherwise("Not normally distributed").alias("interpretation"),
        "skewness", "kurtosis", "sample_size", jb.alias("jarque_bera"),
    )


def complete_profile(df: DataFrame) -> dict[str, DataFrame]:
    """All distribution reports, each part lazy; cache ``df`` first if it is costly."""
    from .correlation import enhanced_correlations

    return {
        "histograms": histograms(df), "histogram_statistics": histogram_statistics(df), "outliers": outliers(df),
        "normality": normality(df), "distributions": distributions(df),
        "categorical": categorical_distributions(df), "correlations": enhanced_correlations(df),
    }

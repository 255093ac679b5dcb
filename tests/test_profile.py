import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators.distribution import (
    categorical_distributions, distributions, histograms, normality, outlier_rows, outliers, shapiro_wilk,
)
from tablewright.operators.profile import (
    column_counts,
    categorical_statistics, dataset_info, introspect, missing_values, numeric_statistics, phase_one, quality_checks, quality_report,
    summary,
)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [(1, 2.0, "a", 7.0), (2, None, "b", 7.0), (3, 4.0, "a", 7.0), (4, 100.0, None, 7.0), (4, 100.0, None, 7.0)],
        "i int, v double, t string, same double")


def test_statistics(small):
    rows = {r.column: r for r in numeric_statistics(small).collect()}
    assert rows["v"].count == 4 if not callable(rows["v"].count) else rows["v"]["count"] == 4
    assert rows["v"]["missing"] == 1 and rows["v"].median == 52.0 and rows["same"].std == 0.0
    cats = categorical_statistics(small).first()
    assert (cats["unique"], cats["top"], cats["freq"], cats["missing"]) == (2, "a", 2, 2)
    assert {r["column"]: r["percent"] for r in missing_values(small).collect()} == {"v": 20.0, "t": 40.0}


def test_all_null_and_empty(spark):
    df = spark.createDataFrame([(None, None)], "a double, t string")
    row = numeric_statistics(df).first()
    assert (row["count"], row["mean"], row["median"], row["missing"]) == (0, None, None, 1)
    empty = df.limit(0)
    report = quality_report(empty).first()
    assert (report.completeness, report.uniqueness, report.duplicate_rows) == (100.0, 100.0, 0)
    assert summary(empty).first().total_rows == 0 and dataset_info(empty).first().duplicates == 0


def test_approximate_forms(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 40).cast("double").alias("v"), F.lit(None).cast("string").alias("t"))
    rows = {r.name: r for r in introspect(df, approx=True).collect()}
    assert rows["id"].is_potential_key and not rows["v"].is_potential_key and rows["t"].null_count == 5000
    assert abs(rows["v"].unique_count - 40) <= 2
    exact, approx = ({r.column: r for r in numeric_statistics(df, approx=a).collect()} for a in (False, True))
    assert abs(exact["id"].median - approx["id"].median) <= 2 and approx["v"].q25 == 9.0


def test_quality(small):
    row = quality_report(small).first()
    assert (row.completeness, row.uniqueness, row.overall_quality_score) == (85.0, 80.0, 82.5)
    assert {r["name"]: r["status"] for r in quality_checks(small).collect()} == {
        "Data Completeness": "WARNING", "Data Uniqueness": "WARNING"}
    assert set(phase_one(small)) >= {"summary", "numeric_statistics", "quality_report"}


def test_constant_column_has_no_shape(small):
    rows = {r.column: r for r in distributions(small).collect()}
    assert rows["same"].skewness is None and rows["same"].distribution_type is None
    assert rows["same"].coefficient_of_variation == 0.0


@pytest.mark.parametrize("bins", [15, 7])
def test_histogram_equals_numpy(spark, bins):
    df = spark.range(5000).select(
        ((F.col("id") * 37) % 1009 / 10.0).alias("a"), F.lit(4.0).alias("k"), ((F.col("id") % 16) / 10.0).alias("edge"))
    pdf = df.toPandas()
    got = histograms(df, bins).toPandas()
    for c in ("a", "k", "edge"):
        counts, edges = np.histogram(pdf[c], bins=bins)
        part = got[got["column"] == c].sort_values("bin")
        assert part["frequency"].tolist() == counts.tolist()
        assert part["low"].tolist() == pytest.approx(edges[:-1].tolist()) and part["high"].iloc[-1] == pytest.approx(edges[-1])
        assert part["frequency"].sum() == len(pdf)


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,), (-300.0,), (None,)], "v double")
    row = outliers(df).first()
    assert (row.outlier_count, row.min_outlier, row.max_outlier, row.n) == (2, -300.0, 500.0, 22)
    assert {r.v for r in outlier_rows(df, "v").collect()} == {500.0, -300.0}
    assert outliers(df.filter("v < 3 AND v >= 0")).count() == 0  # fewer than four values


def test_top_categories_count_null_as_value(spark):
    df = spark.createDataFrame([("a",)] * 3 + [(None,)] * 4 + [("b",)] * 3 + [("c",)], "t string")
    rows = categorical_distributions(df, 3).orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in rows] == [(None, 4), ("a", 3), ("b", 3)]
    assert rows[0].unique_values == 3 and rows[0].missing_count == 4


def brute_force_shapiro(values):
    """W from the weight vector itself, for n > 5."""
    x, n = np.sort(np.asarray(values, float)), len(values)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), float(m @ m)
    last = m[-1] / math.sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.07119 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    nxt = m[-2] / math.sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, nxt, -last, -nxt
    return float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())


def test_shapiro_published_example(spark):
    # Weights of eleven men (Shapiro and Wilk 1965; Royston gives W = 0.79 and p = 0.0067).
    men = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]
    row = shapiro_wilk(spark.createDataFrame([(v,) for v in men], "v double")).first()
    assert row.statistic == pytest.approx(0.79, abs=0.005) and row.p_value == pytest.approx(0.0067, abs=0.0006)


def test_shapiro_brute_force_with_ties_and_a_hot_value(spark):
    values = [float((i * 7919) % 997) for i in range(2500)] + [100.0] * 2000
    row = shapiro_wilk(spark.createDataFrame([(v,) for v in values], "v double").repartition(5)).first()
    assert row.statistic == pytest.approx(brute_force_shapiro(values), abs=1e-10) and row.sample_size == 4500


def test_shapiro_chunks_of_ranks(spark, monkeypatch):
    from tablewright.operators import distribution

    monkeypatch.setattr(distribution, "_CHUNK", 7)
    values = [1.0] * 40 + [2.0] * 25 + [3.5, 9.0]
    row = distribution.shapiro_wilk(spark.createDataFrame([(v,) for v in values], "v double")).first()
    assert row.statistic == pytest.approx(brute_force_shapiro(values), abs=1e-12)


def test_normality_decides(spark):
    n = 400
    normal = [NormalDist(5, 2).inv_cdf((i + 0.5) / n) for i in range(n)]
    df = spark.createDataFrame([(v, v**4, 3.0) for v in normal], "bell double, skewed double, same double")
    rows = {r.column: r for r in normality(df).collect()}
    assert rows["bell"].is_normal == 1 and rows["skewed"].is_normal == 0
    assert rows["bell"].jarque_bera < 1 < rows["skewed"].jarque_bera
    assert shapiro_wilk(df.limit(2)).count() == 0


def test_small_samples(spark):
    for values, w in (([1.0, 2.0, 4.0], 0.9643), ([1.0, 2.0, 3.0, 4.0, 10.0], None)):
        row = shapiro_wilk(spark.createDataFrame([(v,) for v in values], "v double")).first()
        assert 0 < row.statistic <= 1 and 0 <= row.p_value <= 1
        if w:
            assert row.statistic == pytest.approx(w, abs=1e-3)


def test_column_counts_tell_values_of_every_type_apart(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a", b"x", [1], {"k": 1}), (1, -0.0, "a" * 200, b"", [], {}), (2, 0.0, "a" * 201, None, [1], None), (None, None, "", b"x", None, {})],
        "n int, d double, t string, b binary, l array<int>, m map<string,int>").withColumn("c", F.col("n").cast("decimal(30,2)"))
    got = {r.column: (r.row_count, r.null_count, r.unique_count) for r in column_counts(df).collect()}
    assert got == {"n": (4, 1, 2), "d": (4, 1, 2), "t": (4, 0, 4), "b": (4, 1, 2), "l": (4, 1, 2), "m": (4, 1, 2), "c": (4, 1, 2)}
    plan = column_counts(df.select("n", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "as string" not in plan

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.tails import correlation_p, incomplete_beta
from tablewright.operators import correlation as c


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(600, 20))
    base[:, 1] = base[:, 0] * 2 + rng.normal(size=600) * 0.1
    base[:, 2] = -base[:, 0] + rng.normal(size=600) * 0.6
    base[:, 3] = 5e6 + base[:, 3] * 1e-2  # large offset, small spread
    base[:, 19] = 0.1  # constant
    rows = [[None if (i * 31 + j) % 41 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(base)]
    return spark.createDataFrame(rows, ", ".join(f"x{j} double" for j in range(20))).repartition(6)


def _check(frame, pdf, columns):
    want = pdf[columns].corr()
    got = {(r.column1, r.column2): r for r in frame.collect()}
    assert len(got) == len(columns) * (len(columns) - 1) // 2
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            if "x19" in (a, b):
                assert got[a, b].correlation is None
            else:
                assert got[a, b].correlation == pytest.approx(want.loc[a, b], abs=1e-7)
                assert got[a, b].n == len(pdf[[a, b]].dropna())


def test_few_columns_one_aggregate(data):
    columns = ["x0", "x1", "x2", "x3", "x19"]
    pdf = data.toPandas()
    _check(c.pair_correlations(data, columns), pdf, columns)
    _check(c.pair_correlations(data, columns, listwise=True), pdf[columns].dropna(), columns)


def test_many_columns_matrix_partials(data):
    pdf = data.toPandas()
    _check(c.pair_correlations(data), pdf, list(pdf.columns))
    _check(c.pair_correlations(data, listwise=True), pdf.dropna(), list(pdf.columns))


def test_too_few_columns(data):
    assert c.pair_correlations(data.select("x0")).count() == 0  # a report on such a table is empty, not an error


def test_the_number_of_columns_does_not_change_a_pair(spark):
    rows = [(1e15 + i, 1e15 + 2.0 * i, float("nan") if i == 3 else i % 7 * 1.0, None if i == 5 else -1.0 * i, 4.0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, k double")
    wide = df.selectExpr("*", "a * 2 AS e", "c + 1 AS f", "d * d AS g")
    few = {}
    for names in (["a", "b", "k"], ["a", "c", "d"], ["b", "c", "k"]):
        few |= {(x.column1, x.column2): (x.n, x.correlation) for x in c.pair_correlations(df, names).collect()}
    many = {(x.column1, x.column2): (x.n, x.correlation) for x in c.pair_correlations(wide).collect()}
    for pair, (n, r) in few.items():
        assert many[pair][0] == n
        assert (r is None) == (many[pair][1] is None) and (r is None or abs(r - many[pair][1]) < 1e-9)
    assert abs(many["a", "b"][1] - 1) < 1e-9 and many["a", "k"][1] is None and many["a", "c"][0] == 199


def test_p_value_against_the_jvm(spark):
    dist = spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution
    for r, n in ((0.1, 30), (0.5, 12), (-0.95, 5), (0.01, 100000), (0.3, 3)):
        t = abs(r) * ((n - 2) / (1 - r * r)) ** 0.5
        want = 2 * dist(float(n - 2)).cumulativeProbability(-t)
        assert correlation_p(r, n) == pytest.approx(want, rel=1e-8)
    assert correlation_p(0.5, 2) == 1.0 and correlation_p(1.0, 10) == 0.0 and correlation_p(None, 10) is None
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)


def test_strength_bounds_differ_between_reports(spark):
    from tablewright.functions.numbers import matrix_strength, pair_strength

    row = spark.range(1).select(pair_strength(F.lit(0.3)).alias("a"), matrix_strength(F.lit(0.3)).alias("b"),
                                pair_strength(F.lit(-0.9)).alias("d"), matrix_strength(F.lit(-0.9)).alias("e")).first()
    assert tuple(row) == ("Weak", "Very Weak", "Very Strong", "Strong")


def test_reports_hang_together(data):
    columns = ["x0", "x1", "x2", "x3"]
    pairs = c.pair_correlations(data, columns, listwise=True)
    matrix = c.correlation_matrix(pairs, columns).toPandas()
    wide = matrix.pivot(index="x", columns="y", values="correlation")
    assert np.allclose(wide, wide.T) and matrix["abs_correlation"].max() == 1.0
    assert sum(c.strength_distribution(pairs).first()) == 6
    stats = c.correlation_statistics(pairs).first()
    assert stats.total_pairs == 6 and stats.min_correlation <= stats.median_correlation <= stats.max_correlation


def test_vif(data):
    columns = ["x0", "x1", "x2"]
    pairs = c.pair_correlations(data, columns, listwise=True)
    r = data.toPandas()[columns].dropna().corr().to_numpy()
    exact = {x.feature: x.vif_score for x in c.vif_exact(pairs).collect()}
    assert [exact[k] for k in columns] == pytest.approx(list(np.diag(np.linalg.inv(r))))
    approx = {x.feature: x for x in c.vif(pairs).collect()}
    for i, k in enumerate(columns):
        r2 = np.delete(r[i] ** 2, i).mean()
        assert approx[k].vif_score == pytest.approx(1 / (1 - r2 + 0.0001))


def test_identical_columns_score_100(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    scores = c.vif(c.pair_correlations(df, listwise=True))
    assert {r.vif_score for r in scores.collect()} == {100.0}
    assert c.collinearity_level(scores).first().level == "HIGH" and c.problem_features(scores).count() == 2
    warnings = c.collinearity_warnings(c.pair_correlations(df))
    assert warnings.count() == 3 and c.collinearity_assessment(warnings).first().warning_count == 3


def test_no_warnings(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)], "a double, b double")
    row = c.collinearity_assessment(c.collinearity_warnings(c.pair_correlations(df))).first()
    assert row.warning_count == 0 and row.overall_assessment.startswith("No ")


def test_ward_by_hand():
    d = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.2], [0.9, 0.9, 0.2, 0]])
    assert c.ward_groups(d, 0.5) == [1, 1, 2, 2]
    assert c.ward_groups(d, 0.15) == [1, 1, 2, 3]
    # height of the last merge: Ward's update of 0.9 apart pairs
    assert c.ward_groups(d, 2.0) == [1, 1, 1, 1]


def test_connectivity_and_insights(data):
    pairs = c.pair_correlations(data, ["x0", "x1", "x2", "x3"], listwise=True)
    rows = {r.feature: r for r in c.feature_connectivity(pairs).collect()}
    assert rows["x0"].strongly_correlated == 2 and rows["x0"].connectivity_score == pytest.approx(2 / 3)
    kinds = {(r.kind, r.feature1, r.feature2) for r in c.relationship_insights(pairs).collect()}
    assert ("strongest_positive", "x0", "x1") in kinds and ("strongest_negative", "x0", "x2") in kinds


def test_complete_analysis_reads_data_once(data):
    parts = c.complete_analysis(data.select("x0", "x1", "x2"))
    assert parts["clusters"].count() == 3 and parts["matrix"].count() == 9
    parts["pairs"].unpersist()

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import evaluation as e


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.range(4000).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.round(((F.col("id") * 7919) % 200) / 250.0 + F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.0), 3).alias("s"))
    return df, df.toPandas()


@pytest.fixture(scope="module")
def counts(scored):
    return e.score_counts(scored[0], "y", "s")


def _auc(pdf):
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_with_ties(scored, counts):
    row = e.auc_and_ap(counts).first()
    assert row.auc == pytest.approx(_auc(scored[1]))
    pdf = scored[1]
    ap = 0.0
    for t in sorted(pdf.s.unique(), reverse=True):
        chosen = pdf[pdf.s >= t]
        ap += ((pdf.s == t) & (pdf.y == 1)).sum() / (pdf.y == 1).sum() * (chosen.y == 1).mean()
    assert row.average_precision == pytest.approx(ap)


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    counts = e.score_counts(df, "y", "s")
    assert e.auc_and_ap(counts).first().auc == 0.0
    row = e.metrics(e.confusion(counts, 0.95)).first()
    assert (row.precision, row.recall, row.f1_score, row.false_positive_rate) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("t", [0.0, 0.2, 0.5, 1.5])
def test_confusion(scored, counts, t):
    pdf, row = scored[1], e.confusion(counts, t).first()
    hit = pdf.s >= t
    assert (row.tn, row.fp, row.fn, row.tp) == (
        (~hit & (pdf.y == 0)).sum(), (hit & (pdf.y == 0)).sum(), (~hit & (pdf.y == 1)).sum(), (hit & (pdf.y == 1)).sum())
    assert row.total == len(pdf)


def test_roc_shape(counts):
    points = e.roc_curve(counts).orderBy("position").collect()
    assert (points[0].fpr, points[0].tpr, points[0].threshold) == (0.0, 0.0, None)
    assert (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    assert [p.position for p in points] == list(range(len(points)))
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(points, points[1:]))
    area = np.trapezoid([p.tpr for p in points], [p.fpr for p in points])
    corners = e.roc_curve(counts, drop_intermediate=True).orderBy("position").collect()
    assert len(corners) < len(points)
    assert np.trapezoid([p.tpr for p in corners], [p.fpr for p in corners]) == pytest.approx(area)
    assert e.auc_and_ap(counts).first().auc == pytest.approx(area)


def test_pr_shape(counts):
    points = e.pr_curve(counts).orderBy("position").collect()
    assert points[0].recall == 1.0 and (points[-1].recall, points[-1].precision) == (0.0, 1.0)
    assert all(a.threshold < b.threshold for a, b in zip(points[:-1], points[1:-1]))


def test_downsample_like_linspace(spark):
    for n in (1, 50, 100, 101, 777):
        df = spark.range(n).withColumnRenamed("id", "position")
        want = set(np.unique(np.concatenate([[0], np.linspace(0, n - 1, min(n, 100), dtype=int), [n - 1]])))
        assert {r.position for r in e.downsample(df).collect()} == want


def test_threshold_search(scored, counts):
    pdf = scored[1]
    grid = e.thresholds()
    assert len(grid) == 81
    best = max(grid, key=lambda t: (((pdf.s >= t) & (pdf.y == 1)).sum() * 1000 - ((pdf.s >= t) & (pdf.y == 0)).sum() * 500
                                    - ((pdf.s < t) & (pdf.y == 1)).sum() * 2000, -t))
    assert e.optimal_threshold(counts).first().optimal_threshold == pytest.approx(round(best, 2))
    assert e.threshold_profits(counts).count() == 81


def test_repartitioning_changes_nothing(scored):
    df, _ = scored
    rows = [tuple(e.threshold_evaluation(e.score_counts(df.repartition(n), "y", "s")).first()) for n in (1, 9)]
    assert rows[0] == rows[1]


def test_labels_readiness_and_score(spark, counts):
    df = spark.createDataFrame([("no",), ("yes",), ("no",), (None,)], "t string")
    assert {(r.t, r.label_code) for r in e.encode_labels(df, "t").collect()} == {("no", 0), ("yes", 1), (None, None)}
    evaluated = e.threshold_evaluation(counts)
    criteria = e.readiness_criteria(evaluated, has_model=False, has_importance=False, has_scaler=False)
    row = e.readiness_summary(criteria).first()
    assert row.total_criteria == 11 and row.overall_status == "NOT_READY"
    m = evaluated.first()
    want = m.accuracy * 15 + m.precision * 20 + m.recall * 20 + m.f1_score * 25 + m.auc_roc * 20
    assert e.overall_score(evaluated).first().overall_score == pytest.approx(round(want, 1))


def test_impact_scaled(counts):
    plain, scaled = e.business_impact(e.confusion(counts)).first(), e.business_impact(e.confusion(counts), volume=8000).first()
    assert scaled.profit == pytest.approx(plain.profit * 2) and scaled.at_volume == 8000
    assert scaled.approval_rate == pytest.approx(plain.approval_rate, abs=1e-4)


def test_multiclass_collapse(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("c", "a")], "y string, p string")
    row = e.collapse_matrix(e.confusion_matrix(df, "y", "p")).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.total) == (2, 1, 1, 1, 5)

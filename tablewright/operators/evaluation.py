"""Model evaluation from a label and a score column.

The data is read once into one row per distinct score (positives, negatives);
confusion matrices, curves, thresholds and profits are all taken from that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio, share
from ..functions.numbers import correlation, gap_status, target_strength
from ..functions.text import model_id
from .correlation import pair_correlations
from .joins import join_lookup
from .ranking import dense_index, running


def encode_labels(df: DataFrame, label: str, code: str = "label_code") -> DataFrame:
    """Add the 0-based position of the label among the sorted distinct labels."""
    codes = dense_index(df, label, code).withColumnRenamed(label, "_label")
    return join_lookup(df, codes, col(label) == F.col("_label")).drop("_label")


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score: positives and negatives (label 1 and 0)."""
    y = col(label).cast("int")
    return (
        df.filter(col(label).isNotNull() & col(score).isNotNull())
        .groupBy(col(score).cast("double").alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    )


def confusion(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row tn, fp, fn, tp, total; a score at the threshold is predicted positive."""
    hit = F.col("score") >= F.lit(float(threshold))

    def total(value: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0))

    return counts.agg(
        total("neg", ~hit).alias("tn"), total("neg", hit).alias("fp"),
        total("pos", ~hit).alias("fn"), total("pos", hit).alias("tp"),
    ).withColumn("total", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Cells of the matrix for any number of classes: actual, predicted, n."""
    return df.groupBy(col(label).alias("actual"), col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def collapse_matrix(cells: DataFrame) -> DataFrame:
    """A multiclass matrix as one binary summary: the trace is tp, the errors are halved into fp and fn."""
    return cells.agg(
        F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    ).withColumn("fp", F.floor((F.col("total") - F.col("tp")) / 2)).withColumn("fn", F.col("fp")).select(
        (F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), "fp", "fn", "tp", "total")


def metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, error rates from a confusion row; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.select(
        "*",
        F.round(ratio(tp + tn, F.col("total")), 6).alias("accuracy"),
        F.round(ratio(tp, tp + fp), 6).alias("precision"),
        F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1_score"),
        F.round(ratio(fp, fp + tn), 6).alias("false_positive_rate"),
        F.round(ratio(fn, fn + tp), 6).alias("false_negative_rate"),
    )


def _cumulated(counts: DataFrame) -> DataFrame:
    """Counts with tp and fp at or above each score and the 1-based place from the top.

    all_pos, all_neg and scores hold the totals.
    """
    return running(
        counts.withColumn("down", -F.col("score")), [], ["down"],
        sums={"tp": F.col("pos"), "fp": F.col("neg"), "place": F.lit(1).cast("bigint")},
        totals_of={"all_pos": "tp", "all_neg": "fp", "scores": "place"},
    ).drop("down")


def auc_and_ap(counts: DataFrame) -> DataFrame:
    """One row: ROC AUC (ties count half; 0 without both classes) and average precision."""
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    sums = _cumulated(counts).agg(
        F.sum(neg * (tp - pos / 2)).alias("wins"), F.sum(pos * tp / (tp + fp)).alias("area"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
    )
    return sums.select(
        F.coalesce(F.try_divide("wins", F.col("p").cast("double") * F.col("n")), F.lit(0.0)).alias("auc"),
        ratio(F.col("area"), F.col("p")).alias("average_precision"),
    )


def threshold_evaluation(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: confusion matrix, metrics, rates and AUC."""
    return metrics(confusion(counts, threshold)).withColumn(
        "auc_roc", F.round(auc_and_ap(counts).select("auc").scalar(), 6))


def roc_curve(counts: DataFrame, drop_intermediate: bool = False) -> DataFrame:
    """ROC points: position, fpr, tpr, threshold, from (0, 0) with a null threshold to (1, 1).

    ``drop_intermediate`` leaves out points on a straight line between their
    neighbours, found by joining each point with the next position.
    """
    points = _cumulated(counts)
    if drop_intermediate:
        following = points.select((F.col("place") - 1).alias("_p"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
        points = points.join(following, F.col("place") == F.col("_p"), "left").filter(
            F.col("_p").isNull() | (F.col("place") == 1)
            | (F.col("pos") != F.col("_pos")) | (F.col("neg") != F.col("_neg"))
        ).drop("_p", "_pos", "_neg")
    curve = points.select(
        F.col("place").alias("position"), share(F.col("fp"), F.col("all_neg")).alias("fpr"),
        share(F.col("tp"), F.col("all_pos")).alias("tpr"), F.col("score").alias("threshold"))
    start = counts.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).cast("bigint").alias("position"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(None).cast("double").alias("threshold"))
    return start.union(curve)


def pr_curve(counts: DataFrame) -> DataFrame:
    """Precision-recall points by rising threshold, closed by (recall 0, precision 1)."""
    points = _cumulated(counts)
    curve = points.select(
        (F.col("scores") - F.col("place")).alias("position"),
        ratio(F.col("tp"), F.col("all_pos")).alias("recall"),
        share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.col("score").alias("threshold"))
    last = counts.agg(F.count(F.lit(1)).alias("position")).select(
        "position", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"),
        F.lit(None).cast("double").alias("threshold"))
    return curve.union(last)


def downsample(points: DataFrame, position: str = "position", max_points: int = 100,
               last: Column | None = None) -> DataFrame:
    """At most ``max_points`` evenly spaced points by a dense 0-based position; first and last stay.

    ``last`` is the greatest position where it is known more cheaply than from the points.
    """
    if last is None:
        last = points.agg(F.max(position).alias("last")).scalar()
    i, greatest = F.col("id"), last
    last = F.col("_last")
    wanted = points.sparkSession.range(0, max_points, 1, 1).withColumn("_last", greatest).select(
        F.when(last < max_points, i).when(i == max_points - 1, last)
        .otherwise(F.floor(i * (last / F.lit(float(max_points - 1))))).alias("_at")
    ).distinct()
    # ``wanted`` has at most max_points rows, all different.
    return points.join(F.broadcast(wanted), col(position) == F.col("_at")).drop("_at")


def thresholds(start: float = 0.1, stop: float = 0.91, step: float = 0.01) -> list[float]:
    """The thresholds searched, as the same doubles NumPy's ``arange`` gives."""
    return [float(t) for t in np.arange(start, stop, step)]


def threshold_profits(counts: DataFrame, cost_fp: float = 500, cost_fn: float = 2000,
                      revenue_tp: float = 1000) -> DataFrame:
    """Confusion counts and profit at each of the 81 thresholds.

    Scores are reduced to the number of thresholds they reach (82 groups); the
    rest runs on those.
    """
    grid = thresholds()
    levels = F.array(*[F.lit(t) for t in grid])
    reached = counts.withColumn("reach", F.size(F.filter(levels, lambda t: t <= F.col("score"))))
    by_reach = reached.groupBy("reach").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # 82 rows at most: one list of (reach, pos, neg).
    packed = by_reach.agg(F.collect_list(F.struct("reach", "pos", "neg")).alias("all"))

    def above(field: str, i: Column) -> Column:
        return F.aggregate(
            "all", F.lit(0).cast("bigint"),
            lambda acc, x: acc + F.when(x["reach"] > i, x[field]).otherwise(F.lit(0).cast("bigint")))

    def below(field: str, i: Column) -> Column:
        return F.aggregate(
            "all", F.lit(0).cast("bigint"),
            lambda acc, x: acc + F.when(x["reach"] <= i, x[field]).otherwise(F.lit(0).cast("bigint")))

    rows = packed.select("all", F.posexplode(levels).alias("i", "threshold")).select(
        "threshold", above("pos", F.col("i")).alias("tp"), above("neg", F.col("i")).alias("fp"),
        below("pos", F.col("i")).alias("fn"), below("neg", F.col("i")).alias("tn"))
    both = ((F.col("tp") + F.col("fn") > 0) | (F.col("tp") + F.col("fp") > 0)) & (
        (F.col("fp") + F.col("tn") > 0) | (F.col("fn") + F.col("tn") > 0))
    return rows.filter(both).withColumn(
        "profit", F.col("tp") * float(revenue_tp) - F.col("fp") * float(cost_fp) - F.col("fn") * float(cost_fn))


def optimal_threshold(counts: DataFrame, cost_fp: float = 500, cost_fn: float = 2000,
                      revenue_tp: float = 1000) -> DataFrame:
    """One row: the lowest threshold of greatest profit, that profit, and a sentence."""
    best = threshold_profits(counts, cost_fp, cost_fn, revenue_tp).agg(
        F.max_by("threshold", F.struct("profit", -F.col("threshold"))).alias("t"), F.max("profit").alias("p"))
    return best.select(
        F.round("t", 2).alias("optimal_threshold"), F.round("p", 2).alias("optimal_profit"),
        F.format_string("Adjust threshold to %.2f for maximum profit of %.0f", F.col("t"), F.col("p"))
        .alias("recommendation"))


def business_impact(cm: DataFrame, cost_fp: float = 500, cost_fn: float = 2000, revenue_tp: float = 1000,
                    volume: int | None = None) -> DataFrame:
    """One row of costs, revenue and profit from a confusion row, optionally scaled to a volume.

    The baseline approves everyone.
    """
    scale = F.try_divide(F.lit(float(volume)), F.col("total")) if volume else F.lit(1.0)
    scale = F.coalesce(scale, F.lit(1.0))
    scaled = cm.select("total", *[F.round(F.col(c) * scale).cast("bigint").alias(c) for c in ("tn", "fp", "fn", "tp")])
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    profit = tp * float(revenue_tp) - fp * float(cost_fp) - fn * float(cost_fn)
    baseline = (tp + fn) * float(revenue_tp) - (tn + fp) * float(cost_fp)
    at_volume = F.lit(volume).cast("bigint") if volume else F.col("total")
    return scaled.select(
        tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"),
        (fp * float(cost_fp)).alias("false_positive_cost"), (fn * float(cost_fn)).alias("false_negative_cost"),
        (fp * float(cost_fp) + fn * float(cost_fn)).alias("total_cost"),
        (tp * float(revenue_tp)).alias("true_positive_revenue"),
        profit.alias("profit"), baseline.alias("baseline_profit"),
        F.round(ratio((profit - baseline) * 100, F.abs(baseline)), 2).alias("improvement_vs_baseline"),
        at_volume.alias("at_volume"), F.round(ratio(tp + fp, at_volume), 4).alias("approval_rate"),
    )


def learning_gap(report: DataFrame, name: str = "Algorithm", train: str = "Train_Score",
                 test: str = "Test_Score") -> DataFrame:
    """Per algorithm: the train-test gap and its status."""
    gap = F.abs(col(train) - col(test))
    return report.select(
        col(name).alias("algorithm"), F.round(col(train), 6).alias("train_accuracy"),
        F.round(col(test), 6).alias("test_accuracy"), F.round(gap, 6).alias("overfitting_ratio"),
        gap_status(gap).alias("status"))


def feature_importance(importances: DataFrame, data: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Share of total importance and correlation with the target per feature.

    ``importances`` holds (feature, importance).  All correlations are one
    aggregate; an undefined one is 0.
    """
    y = col(label).cast("double")
    wide = data.agg(*[correlation(col(f), y).alias(f"_r{i}") for i, f in enumerate(features)])
    with_target = wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("_f"), F.coalesce(F.col(f"_r{i}"), F.lit(0.0)).alias("_r")) for i, f in enumerate(features)
    ])))
    total = importances.agg(F.sum("importance").alias("s")).scalar()
    share_of = F.when(total > 0, F.col("importance") / total * 100).otherwise(F.lit(0.0))
    r = F.coalesce(F.col("_r"), F.lit(0.0))
    return importances.join(with_target, F.col("feature") == F.col("_f"), "left").select(
        F.col("feature").alias("name"), F.round(share_of, 2).alias("importance_percent"),
        F.round(r, 4).alias("correlation_with_target"), target_strength(r).alias("correlation_strength"))


def feature_interactions(data: DataFrame, features: Sequence[str], least: float = 0.05, top: int = 10,
                         importance: Mapping[str, float] | None = None, first: int | None = None) -> DataFrame:
    """The ``top`` strongest pairs of features, with sign.

    ``first`` looks at that many features only: those of the highest
    ``importance`` where it is given, else the first by position.
    """
    names = list(features)
    if importance is not None:
        names.sort(key=lambda name: -importance.get(name, 0.0))
    pairs = pair_correlations(data, names[:first])
    r = F.col("correlation")
    return pairs.filter(F.abs(r) > least).select(
        F.col("column1").alias("feature1"), F.col("column2").alias("feature2"),
        F.round(F.abs(r), 4).alias("interaction_strength"),
        F.when(r > 0, "positive").otherwise("negative").alias("interaction_direction"), "i", "j",
    ).orderBy(F.col("interaction_strength").desc(), "i", "j").limit(top).drop("i", "j")


# Words in a model's name that mark it as interpretable.
_INTERPRETABLE = ["forest", "tree", "logistic", "linear", "boost", "xgb", "lgbm", "catboost"]


def readiness_criteria(evaluated: DataFrame, *, gap: DataFrame | None = None, cv: DataFrame | None = None,
                       test_rows: DataFrame | None = None, has_model: bool = True, has_importance: bool = True,
                       has_scaler: bool = True, algorithms: int | None = None,
                       model_name: str = "Unknown") -> DataFrame:
    """Criteria rows: name, category, value, passed.

    ``evaluated`` is the row of ``threshold_evaluation``; ``gap`` one row of
    ``learning_gap``; ``cv`` one row (mean, std); ``test_rows`` one row (n).
    What only a file system can tell comes in as flags.
    """
    def item(name: str, category: str, value: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"),
                        value.cast("double").alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"))

    none = F.lit(None)
    items = [
        item("AUC-ROC", "Performance", F.col("auc_roc"), F.col("auc_roc") >= 0.70),
        item("F1 Score", "Performance", F.col("f1_score"), F.col("f1_score") >= 0.60),
        item("Precision", "Performance", F.col("precision"), F.col("precision") >= 0.50),
        item("Recall", "Performance", F.col("recall"), F.col("recall") >= 0.50),
    ]
    if gap is not None:
        g = gap.select(F.struct("overfitting_ratio", "status").alias("g")).scalar()
        items.append(item("Overfitting Risk", "Stability & Robustness", g["overfitting_ratio"],
                          g["status"].isin("acceptable", "moderate")))
    if cv is not None:
        s = cv.select("std").scalar()
        items.append(item("Cross-Validation", "Stability & Robustness", s, s < 0.05))
    items.append(item("Model Convergence", "Stability & Robustness", none, F.lit(has_model)))
    if test_rows is not None:
        n = test_rows.scalar()
        items.append(item("Test Set Size", "Data Quality", n, n >= 100))
    readable = any(word in model_name.lower() for word in _INTERPRETABLE)
    items += [
        item("Feature Quality", "Data Quality", none, F.lit(has_importance)),
        item("Feature Importance Available", "Explainability", none, F.lit(has_importance)),
        item("Model Interpretability", "Explainability", none, F.lit(readable)),
        item("Model Serialization", "Infrastructure", none, F.lit(has_model)),
        item("Preprocessing Pipeline", "Infrastructure", none, F.lit(has_scaler)),
        item("Algorithm Comparison", "Infrastructure", F.lit(algorithms), F.lit((algorithms or 0) > 1)),
    ]
    return evaluated.select(F.inline(F.array(*items)))


def readiness_summary(criteria: DataFrame) -> DataFrame:
    """One row: passed, total, percentage, READY from 80 %, WARNING from 50 %."""
    return criteria.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total_criteria")).withColumn(
        "_pct", ratio(F.col("passed") * 100, F.col("total_criteria"))).select(
        "passed", "total_criteria", F.round("_pct", 1).alias("pass_percentage"),
        F.when(F.col("_pct") >= 80, "READY").when(F.col("_pct") >= 50, "WARNING").otherwise("NOT_READY")
        .alias("overall_status"))


def overall_score(evaluated: DataFrame) -> DataFrame:
    """One row: weighted score of accuracy, precision, recall, F1 and AUC, at most 100."""
    weights = {"accuracy": 15, "precision": 20, "recall": 20, "f1_score": 25, "auc_roc": 20}
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return evaluated.select(F.round(F.least(total, F.lit(100.0)), 1).alias("overall_score"))


def trained_models(report: DataFrame, problem_type: str = "classification", best: str | None = None) -> DataFrame:
    """Models of a report with their ids, scores and whether they are the best."""
    return report.select(
        model_id(F.col("Algorithm")).alias("id"), F.col("Algorithm").alias("name"),
        F.col("Test_Score").alias("test_score"), F.col("Train_Score").alias("train_score"),
        F.lit(problem_type).alias("problem_type"),
        (F.col("Algorithm") == F.lit(best)).alias("is_best") if best is not None else F.lit(False).alias("is_best"))


def complete_evaluation(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                        costs: Mapping[str, float] | None = None, volume: int | None = None) -> dict[str, DataFrame]:
    """All evaluation parts from one per-score aggregate, which is persisted.

    Unpersist ``result["counts"]`` when done.
    """
    costs = dict(costs or {})
    counts = score_counts(df, label, score).persist()
    evaluated = threshold_evaluation(counts, threshold)
    scores = counts.agg(F.count(F.lit(1))).scalar()  # the last position of either curve
    return {
        "counts": counts, "threshold_evaluation": evaluated,
        "business_impact": business_impact(confusion(counts, threshold), volume=volume, **costs),
        "roc_curve": downsample(roc_curve(counts), last=scores), "pr_curve": downsample(pr_curve(counts), last=scores),
        "areas": auc_and_ap(counts), "optimal_threshold": optimal_threshold(counts, **costs),
        "overall_score": overall_score(evaluated),
    }

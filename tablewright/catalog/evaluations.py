"""E, W4: model evaluation."""

from pyspark.sql import functions as F

from ..operators import evaluation as e
from .base import REPORT_SQL, SCORED_SQL, own, query, r, report, scored, table

_S = SCORED_SQL
_COUNTS = f"(SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {_S} GROUP BY score)"
_CUM = f"""(SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS fp,
  row_number() OVER (ORDER BY score DESC) AS place, sum(pos) OVER ()::BIGINT AS p, sum(neg) OVER ()::BIGINT AS n, count(*) OVER () AS k FROM {_COUNTS})"""


def counts(spark, sf):
    return e.score_counts(scored(spark, sf), "label", "score")


def _cm_sql(source=_S, t="0.5::DOUBLE"):
    return f"""(SELECT count(*) FILTER (WHERE label = 0 AND score < {t}) AS tn, count(*) FILTER (WHERE label = 0 AND score >= {t}) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < {t}) AS fn, count(*) FILTER (WHERE label = 1 AND score >= {t}) AS tp, count(*) AS total FROM {source})"""


_AUC = f"(SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(n)), 6) AS auc FROM {_CUM})"
_METRICS = f"""(SELECT *, round((tp + tn) / total::DOUBLE, 6) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 6), 0) AS "precision",
  coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 6), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6), 0) AS f1_score,
  coalesce(round(fp / nullif(fp + tn, 0)::DOUBLE, 6), 0) AS false_positive_rate, coalesce(round(fn / nullif(fn + tp, 0)::DOUBLE, 6), 0) AS false_negative_rate
  FROM {_cm_sql()})"""


@query("e1_label_encoding", """
SELECT o_orderpriority, code, count(*) AS n FROM orders JOIN (
  SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
  ON v = o_orderpriority GROUP BY o_orderpriority, code""")
def encoding(spark, sf):
    return e.encode_labels(table(spark, sf, "orders"), "o_orderpriority", "code").groupBy("o_orderpriority", "code").agg(
        F.count(F.lit(1)).alias("n"))


@query("e1_label_encoding_wide", """
SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer)""")
def encoding_wide(spark, sf):
    return e.encode_labels(table(spark, sf, "customer").select("c_name"), "c_name", "code")


_DOCS = "(SELECT quality AS label, ((doc_id * 37) % 100 + 60 * quality) / 160.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


@query("e2_confusion_matrix", f"SELECT tn, fp, fn, tp, total FROM {_cm_sql(_DOCS)}")
def matrix(spark, sf):
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id").selectExpr(
        "quality AS label", "((doc_id * 37) % 100 + 60 * quality) / 160.0D AS score")
    return e.confusion(e.score_counts(docs, "label", "score"), 0.5)


_CLASSES = "(SELECT o_orderstatus AS actual, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted FROM orders)"


def _classes(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderstatus AS actual", "CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted")


@query("e2_multiclass_matrix", f"SELECT actual, predicted, count(*) AS n FROM {_CLASSES} GROUP BY actual, predicted")
def multiclass(spark, sf):
    return e.confusion_matrix(_classes(spark, sf), "actual", "predicted")


@query("e2b_multiclass_collapse", f"""
SELECT total - tp - 2 * ((total - tp) // 2) AS tn, (total - tp) // 2 AS fp, (total - tp) // 2 AS fn, tp, total FROM (
  SELECT count(*) FILTER (WHERE actual = predicted) AS tp, count(*) AS total FROM {_CLASSES})""")
def collapse(spark, sf):
    return e.collapse_matrix(e.confusion_matrix(_classes(spark, sf), "actual", "predicted"))


@query("e3_metrics", f"SELECT * FROM {_METRICS}", digits=6)
def metrics(spark, sf):
    return e.metrics(e.confusion(counts(spark, sf), 0.5))


@query("e4_roc_auc", f"SELECT auc, {r('ap', 6)} AS average_precision FROM {_AUC}, (SELECT sum(pos * tp / (tp + fp)::DOUBLE) / any_value(p) AS ap FROM {_CUM})", digits=6)
def auc(spark, sf):
    return e.auc_and_ap(counts(spark, sf))


def _impact_sql(scale, volume):
    return f"""
WITH c AS (SELECT round(tn * {scale})::BIGINT AS tn, round(fp * {scale})::BIGINT AS fp, round(fn * {scale})::BIGINT AS fn,
             round(tp * {scale})::BIGINT AS tp, {volume} AS v FROM {_cm_sql()}),
     m AS (SELECT *, tp * 1000.0 - fp * 500.0 - fn * 2000.0 AS profit, (tp + fn) * 1000.0 - (tn + fp) * 500.0 AS base FROM c)
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, fp * 500.0 AS false_positive_cost, fn * 2000.0 AS false_negative_cost,
  fp * 500.0 + fn * 2000.0 AS total_cost, tp * 1000.0 AS true_positive_revenue, profit, base AS baseline_profit,
  round((profit - base) * 100 / abs(base)::DOUBLE, 2) AS improvement_vs_baseline, v AS at_volume, round((tp + fp) / v::DOUBLE, 4) AS approval_rate FROM m"""


@query("e5_business_impact", _impact_sql("1", "total"))
def impact(spark, sf):
    return e.business_impact(e.confusion(counts(spark, sf), 0.5))


@query("e5_business_impact_at_volume", _impact_sql("(1000000 / total::DOUBLE)", "1000000"))
def impact_at(spark, sf):
    return e.business_impact(e.confusion(counts(spark, sf), 0.5), volume=1_000_000)


_ROC = f"""(SELECT 0 AS position, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, NULL::DOUBLE AS threshold UNION ALL
  SELECT place, fp / n::DOUBLE, tp / p::DOUBLE, score FROM {_CUM})"""


@query("e6_roc_curve", f"SELECT position, {r('fpr', 6)} AS fpr, {r('tpr', 6)} AS tpr, {r('threshold', 6)} AS threshold FROM {_ROC}", digits=6)
def roc(spark, sf):
    return e.roc_curve(counts(spark, sf))


@query("e6_roc_curve_corners", f"""
SELECT 0 AS position, 0.0 AS fpr, 0.0 AS tpr, NULL AS threshold UNION ALL
SELECT place, {r('fp / n::DOUBLE', 6)}, {r('tp / p::DOUBLE', 6)}, {r('score', 6)} FROM (
  SELECT *, lead(pos) OVER (ORDER BY place) AS np, lead(neg) OVER (ORDER BY place) AS nn FROM {_CUM})
WHERE place = 1 OR np IS NULL OR np <> pos OR nn <> neg""", digits=6)
def roc_corners(spark, sf):
    return e.roc_curve(counts(spark, sf), drop_intermediate=True)


@query("e7_pr_curve", f"""
SELECT k - place AS position, {r('tp / p::DOUBLE', 6)} AS recall, {r('tp / (tp + fp)::DOUBLE', 6)} AS "precision", {r('score', 6)} AS threshold FROM {_CUM}
UNION ALL SELECT any_value(k), 0.0, 1.0, NULL FROM {_CUM}""", digits=6)
def pr(spark, sf):
    return e.pr_curve(counts(spark, sf))


@query("e8_downsampled_curve", f"""
WITH s AS (SELECT max(position) AS last FROM {_ROC}),
     w AS (SELECT DISTINCT CASE WHEN last < 100 THEN i WHEN i = 99 THEN last ELSE floor(i * (last::DOUBLE / 99.0::DOUBLE))::BIGINT END AS spot FROM range(100) t(i), s)
SELECT position, {r('fpr', 6)} AS fpr, {r('tpr', 6)} AS tpr, {r('threshold', 6)} AS threshold FROM {_ROC} WHERE position IN (SELECT spot FROM w)""", digits=6)
def downsampled(spark, sf):
    rows = counts(spark, sf)
    return e.downsample(e.roc_curve(rows), last=rows.agg(F.count(F.lit(1))).scalar())


_GRID = "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in e.thresholds()) + ") g(t)"
_PROFITS = f"""(SELECT t AS threshold, sum(CASE WHEN score >= t THEN pos ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN score >= t THEN neg ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN score < t THEN pos ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN score < t THEN neg ELSE 0 END)::BIGINT AS tn,
  tp * 1000.0 - fp * 500.0 - fn * 2000.0 AS profit FROM {_COUNTS}, {_GRID} GROUP BY t)"""


@query("e9_threshold_profits", f"SELECT {r('threshold')} AS threshold, tp, fp, fn, tn, profit FROM {_PROFITS}")
def profits(spark, sf):
    return e.threshold_profits(counts(spark, sf))


@query("e9_optimal_threshold", f"""
SELECT round(threshold, 2) AS optimal_threshold, round(profit, 2) AS optimal_profit,
  printf('Adjust threshold to %.2f for maximum profit of %.0f', threshold, profit::DOUBLE) AS recommendation
FROM {_PROFITS} ORDER BY profit DESC, threshold LIMIT 1""")
def optimal(spark, sf):
    return e.optimal_threshold(counts(spark, sf))


@query("e10_learning_gap", f"""
SELECT "Algorithm" AS algorithm, {own('"Train_Score"', 6)} AS train_accuracy, {own('"Test_Score"', 6)} AS test_accuracy, {own('abs("Train_Score" - "Test_Score")', 6)} AS overfitting_ratio,
  CASE WHEN abs("Train_Score" - "Test_Score") < 0.03 THEN 'acceptable' WHEN abs("Train_Score" - "Test_Score") < 0.08 THEN 'moderate' ELSE 'overfitting' END AS status FROM {REPORT_SQL}""", digits=6)
def gap(spark, sf):
    return e.learning_gap(report(spark, sf))


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LABELED = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_extendedprice > 50000 AND l_quantity > 10 THEN 1 ELSE 0 END AS y FROM lineitem)"


def _labeled(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        *_FEATURES, "CASE WHEN l_extendedprice > 50000 AND l_quantity > 10 THEN 1 ELSE 0 END AS y")


def _importances(spark, sf):
    wide = table(spark, sf, "lineitem").agg(*[F.stddev_samp(c).alias(c) for c in _FEATURES])
    return wide.unpivot([], _FEATURES, "feature", "importance")


@query("e11_feature_importance", " UNION ALL ".join(f"""
SELECT '{c}' AS name, {own(f'stddev_samp({c}) / (stddev_samp(l_quantity) + stddev_samp(l_extendedprice) + stddev_samp(l_discount) + stddev_samp(l_tax)) * 100', 2)} AS importance_percent,
  {own(f'corr({c}, y)', 4)} AS correlation_with_target, CASE WHEN abs(corr({c}, y)) > 0.5 THEN 'strong' WHEN abs(corr({c}, y)) > 0.3 THEN 'moderate'
  WHEN abs(corr({c}, y)) > 0.1 THEN 'weak' ELSE 'negligible' END AS correlation_strength FROM {_LABELED}""" for c in _FEATURES))
def importance(spark, sf):
    return e.feature_importance(_importances(spark, sf), _labeled(spark, sf), _FEATURES, "y")


@query("e12_feature_interactions", f"""
SELECT 'l_extendedprice' AS feature1, 'net' AS feature2, {own('abs(corr(l_extendedprice, net))', 4)} AS interaction_strength, 'positive' AS interaction_direction
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) UNION ALL
SELECT 'l_quantity', 'mirrored', {own('abs(corr(l_quantity, -2 * l_quantity + l_tax))', 4)}, 'negative' FROM lineitem UNION ALL
SELECT 'l_discount', 'net', {own('abs(corr(l_discount, net))', 4)}, 'negative' FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
  HAVING abs(corr(l_discount, net)) > 0.05""")
def interactions(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_discount", "l_extendedprice * (1 - l_discount) AS net", "-2 * l_quantity + l_tax AS mirrored")
    return e.feature_interactions(rows, rows.columns)


def _evaluated(spark, sf):
    return e.threshold_evaluation(counts(spark, sf), 0.5)


def _criteria(spark, sf):
    data = scored(spark, sf)
    best = report(spark, sf).orderBy(F.col("Test_Score").desc(), "Algorithm").limit(1)
    cv = report(spark, sf).agg(F.avg("Test_Score").alias("mean"), F.stddev_pop("Test_Score").alias("std"))
    return e.readiness_criteria(
        _evaluated(spark, sf), gap=e.learning_gap(best), cv=cv, test_rows=data.agg(F.count(F.lit(1))),
        algorithms=3, model_name="RandomForestClassifier", has_scaler=False)


_CRITERIA = f"""(
WITH m AS (SELECT * FROM {_METRICS}, {_AUC}),
     b AS (SELECT abs("Train_Score" - "Test_Score") AS gap FROM {REPORT_SQL} t ORDER BY t."Test_Score" DESC, "Algorithm" LIMIT 1),
     cv AS (SELECT stddev_pop("Test_Score") AS s FROM {REPORT_SQL})
SELECT 'AUC-ROC' AS name, 'Performance' AS category, auc AS value, auc >= 0.7 AS passed FROM m UNION ALL
SELECT 'F1 Score', 'Performance', f1_score, f1_score >= 0.6 FROM m UNION ALL
SELECT 'Precision', 'Performance', "precision", "precision" >= 0.5 FROM m UNION ALL
SELECT 'Recall', 'Performance', recall, recall >= 0.5 FROM m UNION ALL
SELECT 'Overfitting Risk', 'Stability & Robustness', round(gap, 6), gap < 0.08 FROM b UNION ALL
SELECT 'Cross-Validation', 'Stability & Robustness', s, s < 0.05 FROM cv UNION ALL
SELECT 'Model Convergence', 'Stability & Robustness', NULL, true FROM m UNION ALL
SELECT 'Test Set Size', 'Data Quality', total, total >= 100 FROM m UNION ALL
SELECT 'Feature Quality', 'Data Quality', NULL, true FROM m UNION ALL
SELECT 'Feature Importance Available', 'Explainability', NULL, true FROM m UNION ALL
SELECT 'Model Interpretability', 'Explainability', NULL, true FROM m UNION ALL
SELECT 'Model Serialization', 'Infrastructure', NULL, true FROM m UNION ALL
SELECT 'Preprocessing Pipeline', 'Infrastructure', NULL, false FROM m UNION ALL
SELECT 'Algorithm Comparison', 'Infrastructure', 3, true FROM m)"""


@query("e13_readiness_criteria", f"SELECT name, category, {r('value')} AS value, passed FROM {_CRITERIA}")
def criteria(spark, sf):
    return _criteria(spark, sf)


@query("e13_readiness_summary", f"""
SELECT count(*) FILTER (WHERE passed) AS passed, count(*) AS total_criteria, round(count(*) FILTER (WHERE passed) * 100 / count(*)::DOUBLE, 1) AS pass_percentage,
  CASE WHEN count(*) FILTER (WHERE passed) * 100 / count(*)::DOUBLE >= 80 THEN 'READY' WHEN count(*) FILTER (WHERE passed) * 100 / count(*)::DOUBLE >= 50 THEN 'WARNING'
       ELSE 'NOT_READY' END AS overall_status FROM {_CRITERIA}""")
def readiness(spark, sf):
    return e.readiness_summary(_criteria(spark, sf))


@query("e14_overall_score", f"""
SELECT round(least(accuracy * 15 + "precision" * 20 + recall * 20 + f1_score * 25 + auc * 20, 100.0), 1) AS overall_score FROM {_METRICS}, {_AUC}""")
def overall(spark, sf):
    return e.overall_score(_evaluated(spark, sf))


@query("e15_complete_evaluation", f"""
SELECT tn, fp, fn, tp, total, accuracy, "precision", recall, f1_score, false_positive_rate, false_negative_rate, auc AS auc_roc FROM {_METRICS}, {_AUC}""", digits=6)
def complete(spark, sf):
    return e.complete_evaluation(scored(spark, sf), "label", "score")["threshold_evaluation"]


@query("e16_trained_models", f"""
SELECT regexp_replace(replace(lower("Algorithm"), ' ', '_'), '[()]', '', 'g') AS id, "Algorithm" AS name, {r('"Test_Score"')} AS test_score,
  {r('"Train_Score"')} AS train_score, 'classification' AS problem_type, "Algorithm" = 'Brand#1 (ECONOMY)' AS is_best FROM {REPORT_SQL}""")
def models(spark, sf):
    return e.trained_models(report(spark, sf), best="Brand#1 (ECONOMY)")

"""M: preparation, scoring, monitoring."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import monitoring as mon
from ..operators import scoring as s
from ..operators.projection import page_info, validate_rows
from .base import LOG_SQL, ORDERS_WITH_HOLES, REPORT_SQL, orders_with_holes, own, prediction_log, query, r, report, table, ts


@query("m1_fitted_pipeline", f"""
SELECT o_orderkey, {r('(coalesce(o_totalprice, m) - m2) / s2')} AS price, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS is_f
FROM {ORDERS_WITH_HOLES}, (SELECT avg(o_totalprice) AS m FROM {ORDERS_WITH_HOLES}),
  (SELECT avg(v) AS m2, stddev_samp(v) AS s2 FROM (SELECT coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {ORDERS_WITH_HOLES})) AS v FROM {ORDERS_WITH_HOLES}))""")
def pipeline(spark, sf):
    rows = orders_with_holes(spark, sf).select("o_orderkey", "o_totalprice", "o_orderstatus")
    model = s.fit_pipeline(rows, ["o_totalprice"], ["o_orderstatus"])
    values = vector_to_array("features")
    return model.transform(rows).select("o_orderkey", values[0].alias("price"), values[1].alias("is_f"))


_KNOWN = "(SELECT concat('order ', o_orderkey) AS v, o_totalprice FROM orders WHERE o_orderkey % 9 <> 0)"


def _wide(spark, sf):
    rows = table(spark, sf, "orders").withColumn("ref", F.concat(F.lit("order "), F.col("o_orderkey")))
    return rows, s.fit_pipeline(rows.filter("o_orderkey % 9 <> 0"), ["o_totalprice"], ["o_orderstatus", "ref"], most_categories=1000)


@query("m1_wide_categories", f"""
SELECT o_orderkey, 1 + (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderkey % 9 <> 0) + 1 + n + 1 AS places,
  1 + status AS status_at, 1 + (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderkey % 9 <> 0) + 1 + coalesce(code, n) AS ref_at
FROM orders JOIN (SELECT s AS o_orderstatus, row_number() OVER (ORDER BY s) - 1 AS status FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderkey % 9 <> 0)) USING (o_orderstatus)
LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM {_KNOWN}) ON v = concat('order ', o_orderkey), (SELECT count(*) AS n FROM {_KNOWN})""")
def wide_categories(spark, sf):
    rows, prep = _wide(spark, sf)
    # A sparse vector as text is (places,[where],[what]); the scaled number comes first.
    parts = F.split(F.regexp_replace(F.col("features").cast("string"), r"[()\[\]]", ""), ",")
    return prep.transform(rows.select("o_orderkey", "o_totalprice", "o_orderstatus", "ref")).select(
        "o_orderkey", parts[0].cast("bigint").alias("places"), parts[2].cast("bigint").alias("status_at"), parts[3].cast("bigint").alias("ref_at"))


@query("m1_expected_columns", f"""
SELECT o_orderkey, CASE WHEN o_orderkey = 1 THEN 1.0 ELSE 0.0 END AS "ref_order 1", 0 AS absent, {r('(o_totalprice - m) / s')} AS o_totalprice,
  0 AS "ref_order 9", CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS "o_orderstatus_O"
FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM {_KNOWN})""")
def expected_columns(spark, sf):
    rows, prep = _wide(spark, sf)
    return prep.columns(rows, ["o_orderkey"], ["ref_order 1", "absent", "o_totalprice", "ref_order 9", "o_orderstatus_O"])


@query("m2_manual_preparation", f"""
SELECT o_orderkey, {r('(o_totalprice - m) / sd')} AS o_totalprice_scaled, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P", coalesce(code, -1) AS clerk, 0 AS absent
FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'unseen' ELSE concat('clerk ', o_custkey % 40) END AS clerk FROM orders),
  (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders)
LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT concat('clerk ', o_custkey % 40) AS v FROM orders)) ON v = clerk""")
def manual(spark, sf):
    orders = table(spark, sf, "orders")
    train = orders.withColumn("clerk", F.concat(F.lit("clerk "), F.col("o_custkey") % 40))
    batch = train.withColumn("clerk", F.when(F.col("o_orderkey") % 9 == 0, "unseen").otherwise(F.col("clerk")))
    prep = s.fit_manual(train, ["o_totalprice"], ["o_orderstatus", "clerk"])
    return s.transform_manual(batch, prep, ["o_orderkey"], [
        "o_totalprice_scaled", "o_orderstatus_O", "o_orderstatus_P", "clerk", "absent"])


_WEIGHTS = {"o_totalprice": 1e-5, "o_custkey": -0.002, "o_orderkey": 0.00012347}
_P = "1 / (1 + exp(-(-1.5 + o_totalprice * 1e-5::DOUBLE + o_custkey * -0.002::DOUBLE + o_orderkey * 0.00012347::DOUBLE)))"


def _batch(spark, sf):
    return table(spark, sf, "orders").withColumn("p", s.linear_probability(_WEIGHTS, -1.5))


@query("m4_batch_scoring", f"""
SELECT o_orderkey, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction_class, CASE WHEN p >= 0.5 THEN '>50K' ELSE '<=50K' END AS prediction,
  {own('p', 4)} AS probability_positive, {own('1 - p', 4)} AS probability_negative, {own('CASE WHEN p >= 0.5 THEN p ELSE 1 - p END', 4)} AS confidence,
  CASE WHEN greatest(p, 1 - p) >= 0.85 THEN 'high' WHEN greatest(p, 1 - p) >= 0.65 THEN 'moderate' ELSE 'low' END AS confidence_label
FROM (SELECT o_orderkey, {_P} AS p FROM orders)""")
def batch(spark, sf):
    return s.score_rows(_batch(spark, sf).select("o_orderkey", "p"), "p", 0.5, ">50K", "<=50K").drop("p")


_TERMS = """(SELECT o_orderkey, 0 AS pos, 'o_totalprice' AS feature, o_totalprice * 1e-5::DOUBLE AS term FROM orders UNION ALL
  SELECT o_orderkey, 1, 'o_custkey', o_custkey * -0.002::DOUBLE FROM orders UNION ALL SELECT o_orderkey, 2, 'o_orderkey', o_orderkey * 0.00012347::DOUBLE FROM orders)"""


@query("m5_contributions", f"""
SELECT o_orderkey, rank, feature, round(abs(term), 4) AS contribution, round(abs(term) * 100, 1) AS impact,
  CASE WHEN term > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(term) DESC, pos) AS rank FROM {_TERMS}) WHERE rank <= 2""")
def contributions(spark, sf):
    return s.contributions(table(spark, sf, "orders"), "o_orderkey", _WEIGHTS, 2).drop("value")


_IMPORTANCES = {"o_custkey": 0.12345, "o_totalprice": 0.61, "shift": 0.26655}


@query("m5_importance_contributions", """
SELECT o_orderkey, rank, feature, contribution, impact, CASE WHEN v > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (
  SELECT o_orderkey, 1 AS rank, 'o_totalprice' AS feature, 0.61::DOUBLE AS contribution, 61.0::DOUBLE AS impact, o_totalprice::DOUBLE AS v FROM orders UNION ALL
  SELECT o_orderkey, 2, 'shift', 0.2666, 26.7, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 - 1 END FROM orders)""")
def importances(spark, sf):
    rows = table(spark, sf, "orders").withColumn("shift", F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 - 1 END"))
    return s.importance_contributions(rows, "o_orderkey", _IMPORTANCES, 2).drop("value")


@query("m6_explanations", f"""
SELECT o_orderkey, CASE WHEN len(up) > 0 AND len(down) > 0 THEN concat('Key factors supporting yes: ', array_to_string(up, ', '), '. Factors against: ', array_to_string(down, ', '), '.')
  WHEN len(up) > 0 THEN concat('Key factors supporting yes: ', array_to_string(up, ', '), '.')
  WHEN len(down) > 0 THEN concat('Factors against: ', array_to_string(down, ', '), '.') ELSE 'Prediction: yes' END AS explanation
FROM (SELECT o_orderkey, coalesce(list(concat(feature, ' (', o_orderkey, ')') ORDER BY abs(term) DESC, pos) FILTER (WHERE term > 0), [])[1:2] AS up,
             coalesce(list(concat(feature, ' (', o_orderkey, ')') ORDER BY abs(term) DESC, pos) FILTER (WHERE NOT term > 0), [])[1:1] AS down
      FROM (SELECT o_orderkey, 0 AS pos, 'plus' AS feature, o_orderkey * 0.5::DOUBLE AS term FROM orders UNION ALL
            SELECT o_orderkey, 1, 'minus', o_orderkey * -0.25::DOUBLE FROM orders) GROUP BY o_orderkey)""")
def explanations(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey AS plus", "o_orderkey AS minus", "'yes' AS answer")
    return s.explanations(rows, "o_orderkey", {"plus": 0.5, "minus": -0.25}, "answer")


@query("m7_batch_summary", f"""
SELECT count(*) FILTER (WHERE p >= 0.5) AS positive, count(*) FILTER (WHERE p < 0.5) AS negative, {own('avg(p)', 4)} AS average_confidence,
  count(*) FILTER (WHERE abs(p - 0.5) > 0.3) AS high_confidence, count(*) FILTER (WHERE abs(p - 0.5) <= 0.3) AS low_confidence, count(*) AS total
FROM (SELECT {_P} AS p FROM orders)""")
def batch_summary(spark, sf):
    return s.batch_summary(s.score_rows(_batch(spark, sf), "p"), "p")


@query("m8_batch_status", f"""
SELECT count(*) AS total_records, count(o_custkey) AS successful_records, count(*) - count(o_custkey) AS failed_records,
  count(*) AS processed_records, 100.0 AS progress FROM {ORDERS_WITH_HOLES}""")
def batch_status(spark, sf):
    return s.batch_status(validate_rows(orders_with_holes(spark, sf), ["o_custkey"]))


@query("m9_prediction_history", f"""
SELECT id, {ts('t.ts')} AS ts, model, type, prediction, {r('probability')} AS probability, latency_ms, failed
FROM {LOG_SQL} t WHERE type = 'single' AND model = 'forest' ORDER BY t.ts DESC, id LIMIT 20 OFFSET 20""")
def history(spark, sf):
    return mon.prediction_history(prediction_log(spark, sf), "single", "forest", 2, 20)


@query("m9_history_pages", f"""
SELECT 2 AS page, 20 AS "pageSize", count(*) AS "totalItems", greatest(1, ceil(count(*) / 20.0))::BIGINT AS "totalPages"
FROM {LOG_SQL} WHERE type = 'single' AND model = 'forest'""")
def history_pages(spark, sf):
    return page_info(prediction_log(spark, sf).filter("type = 'single' AND model = 'forest'"), 2, 20)


@query("m10_monitoring", f"""
SELECT count(*) FILTER (WHERE NOT failed) AS total_predictions, count(*) FILTER (WHERE failed) AS errors,
  round(avg(latency_ms) FILTER (WHERE NOT failed), 1) AS average_latency_ms, round(count(*) FILTER (WHERE failed) / count(*)::DOUBLE, 4) AS error_rate,
  round(count(*) FILTER (WHERE NOT failed) / count(DISTINCT CASE WHEN NOT failed THEN hour(ts) END)::DOUBLE, 0) AS throughput FROM {LOG_SQL}""")
def monitoring(spark, sf):
    return mon.monitoring_stats(prediction_log(spark, sf))


@query("m10_confidence_distribution", f"""
SELECT "range", count(id) AS count FROM (VALUES ('0.0-0.2'), ('0.2-0.4'), ('0.4-0.6'), ('0.6-0.8'), ('0.8-1.0')) v("range")
LEFT JOIN (SELECT id, CASE WHEN probability < 0.2 THEN '0.0-0.2' WHEN probability < 0.4 THEN '0.2-0.4' WHEN probability < 0.6 THEN '0.4-0.6'
  WHEN probability < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS b FROM {LOG_SQL} WHERE NOT failed) ON b = "range" GROUP BY "range" """)
def confidence(spark, sf):
    return mon.confidence_distribution(prediction_log(spark, sf))


@query("m10_prediction_distribution", f"SELECT prediction, count(*) AS count FROM {LOG_SQL} WHERE NOT failed GROUP BY prediction")
def classes(spark, sf):
    return mon.prediction_distribution(prediction_log(spark, sf), [">50K", "<=50K"])


@query("m10_hourly_trend", f"""
SELECT h AS hour, count(id) AS predictions, coalesce({own('avg(probability)', 3)}, 0.0) AS avg_confidence
FROM range(24) t(h) LEFT JOIN {LOG_SQL} ON hour(ts) = h AND NOT failed GROUP BY h""")
def trend(spark, sf):
    return mon.hourly_trend(prediction_log(spark, sf))


HOURLY_SQL = f"""
SELECT {ts("date_trunc('hour', ts)")} AS window_start, count(*) FILTER (WHERE NOT failed) AS predictions, count(*) FILTER (WHERE failed) AS errors,
  count(*) FILTER (WHERE NOT failed AND probability >= 0.4 AND probability < 0.6) AS borderline,
  coalesce({r('avg(probability) FILTER (WHERE NOT failed)')}, 0.0) AS mean_probability, {r('count(*) FILTER (WHERE failed) / count(*)::DOUBLE')} AS error_rate
FROM {LOG_SQL} GROUP BY date_trunc('hour', ts)"""


@query("m10_hourly_windows", HOURLY_SQL)
def windows(spark, sf):
    return mon.hourly_windows(prediction_log(spark, sf))


@query("m11_alerts", f"""
WITH t AS (SELECT count(*) FILTER (WHERE NOT failed) AS n, count(*) FILTER (WHERE failed) AS e,
             count(*) FILTER (WHERE NOT failed AND probability >= 0.4 AND probability < 0.6) AS b FROM {LOG_SQL})
SELECT 'error_rate' AS alert, 'warning' AS severity, concat('Error rate above 5%: ', e, '/', n + e, ' failed predictions') AS message FROM t WHERE n + e > 10 AND e / (n + e)::DOUBLE > 0.05
UNION ALL SELECT 'borderline', 'warning', concat('High proportion of borderline predictions (', b, ' in 0.4-0.6 range)') FROM t WHERE n > 10 AND b / n::DOUBLE > 0.3""")
def alerts(spark, sf):
    return mon.alerts(prediction_log(spark, sf))


@query("m12_deployed_models", f"""
SELECT regexp_replace(replace(lower("Algorithm"), ' ', ''), '[()]', '', 'g') AS id, "Algorithm" AS algorithm, accuracy, rank,
  CASE WHEN rank = 1 THEN 'active' ELSE 'available' END AS status
FROM (SELECT "Algorithm", accuracy, row_number() OVER (ORDER BY accuracy DESC, "Algorithm") AS rank FROM (
  SELECT "Algorithm", {own('CASE WHEN "Test_Score" * 2 > 1 THEN "Test_Score" * 2 / 100 ELSE "Test_Score" * 2 END', 4)} AS accuracy FROM {REPORT_SQL}))""")
def deployed(spark, sf):
    return mon.deployed_models(report(spark, sf).withColumn("Test_Score", F.col("Test_Score") * 2))


@query("h9_model_lookup", f"""
SELECT "Algorithm", {r('"Test_Score"')} AS "Test_Score" FROM (
  (SELECT * FROM {REPORT_SQL} t ORDER BY t."Test_Score" DESC, "Algorithm" LIMIT 1) UNION ALL
  (SELECT * FROM {REPORT_SQL} WHERE "Algorithm" = 'Brand#1 (ECONOMY)'))""")
def lookup(spark, sf):
    rows = report(spark, sf)
    return mon.find_model(rows, "best").union(mon.find_model(rows, "brand#1(economy)")).select("Algorithm", "Test_Score")


@query("m13_stratified_split", """
WITH h AS (SELECT o_orderkey, o_orderstatus, ('0x' || substr(md5(concat('42|', o_orderkey)), 1, 8))::BIGINT AS h FROM orders),
     c AS (SELECT o_orderstatus AS s, quantile_cont(h::DOUBLE, 0.2) AS cut FROM h GROUP BY o_orderstatus)
SELECT o_orderkey, o_orderstatus, CASE WHEN h <= cut THEN 'test' ELSE 'train' END AS split FROM h JOIN c ON s = o_orderstatus""")
def split(spark, sf):
    return s.split_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


def _prepared(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label",
        "o_totalprice / 100000 + (o_orderkey * 7919) % 100 / 50.0D AS a", "o_custkey / 1000 AS b")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(s.split_rows(rows, "o_orderkey", "label"))
    return data.filter("split = 'train'"), data.filter("split = 'test'")


def _register_training(algorithm):
    @query(f"m14_train_{algorithm.lower()}")
    def train(spark, sf):
        """Fitted numbers depend on the optimiser; the evaluation of the scores is checked in E1-E15."""
        fitted = s.fit_score(*_prepared(spark, sf), algorithm)
        key = "cluster" if algorithm == "KMeans" else "label"
        value = F.count(F.lit(1)) if algorithm == "KMeans" else F.avg("score")
        return fitted.groupBy(F.col(key).alias("class")).agg(F.count(F.lit(1)).alias("n"), value.alias("mean_score"))


for _algorithm in s.ESTIMATORS:
    _register_training(_algorithm)

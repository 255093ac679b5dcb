import math

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import monitoring as mon
from tablewright.operators import registry as reg
from tablewright.operators import scoring as s
from tablewright.operators.evaluation import auc_and_ap, score_counts
from tablewright.operators.projection import error_rows, good_rows, page_info, validate_rows


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, float(i % 10) if i % 9 else None, "abc"[i % 3], f"city {i % 25}") for i in range(200)]
    return spark.createDataFrame(rows, "id int, x double, few string, many string")


def test_pipeline(train):
    model = s.fit_pipeline(train, ["x"], ["few"])
    out = model.transform(train)
    values = s.vector_to_array("features")
    row = out.agg(F.avg(values[0]).alias("m"), F.stddev_samp(values[0]).alias("s")).first()
    assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1)


def test_wide_categories_give_the_same_vectors(spark, train):
    names = ["many", "few"]
    plain, tables = s.fit_pipeline(train, ["x"], names), s.fit_pipeline(train, ["x"], names, most_categories=10)
    assert not plain.dictionaries and list(tables.dictionaries) == ["many"]
    batch = spark.createDataFrame([(1, 4.0, "b", "city 10"), (2, None, None, "nowhere"), (3, 1.0, "z", None)], "id int, x double, few string, many string")
    for rows in (train, batch):
        got = [{r.id: r.features for r in p.transform(rows).collect()} for p in (plain, tables)]
        assert got[0] == got[1] and got[0][1].size == 1 + 26 + 4
    expected = ["many_city 10", "x", "few_b", "few_z", "many_nowhere", "gone"]
    rows = [[tuple(r) for r in p.columns(batch, ["id"], expected).orderBy("id").collect()] for p in (plain, tables)]
    assert rows[0] == rows[1]
    assert [(r[1], r[3], *r[4:]) for r in rows[0]] == [(1.0, 1.0, 0, 0, 0), (0.0, 0.0, 0, 0, 0), (0.0, 0.0, 0, 0, 0)]


def test_wide_categories_have_no_name_for_a_place(spark, train):
    out = s.fit_pipeline(train, ["x"], ["many", "few"], most_categories=10).transform(train)
    assert not out.schema["many__hot"].metadata and not out.schema["features"].metadata
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    million = s.sparse_vector(1_000_000_000, F.array(F.lit(3), F.lit(999_999_999)), F.array(F.lit(float("nan")), F.lit(-1.25e-300)))
    got = spark.range(1).select(million.alias("v")).first().v
    assert got.size == 1_000_000_000 and got.indices.tolist() == [3, 999_999_999]
    assert math.isnan(got.values[0]) and got.values[1] == -1.25e-300


def test_wide_categories_leave_out_zeros_as_the_assembler_does(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0, "a"), (2, 3.0, 5.0, "b"), (3, 2.0, 5.0, "c")], "id int, x double, flat double, many string")
    got = [{r.id: r.features for r in s.fit_pipeline(rows, ["flat", "x"], ["many"], most_categories=m).transform(rows).collect()} for m in (10, 1)]
    assert got[0] == got[1] and got[1][3].indices.tolist() == [4]


def test_wide_categories_of_an_empty_table(spark, train):
    prep = s.fit_pipeline(train.withColumn("many", F.lit(None).cast("string")), ["x"], ["many"], most_categories=-1)
    assert {r.features.toArray()[1] for r in prep.transform(train).collect()} == {1.0}


def test_manual_preparation(spark, train):
    prep = s.fit_manual(train, ["x"], ["few", "many"])
    assert prep.one_hot == {"few": ["a", "b", "c"]} and set(prep.codes) == {"many"}
    batch = spark.createDataFrame([(1, 4.0, "b", "city 10"), (2, None, None, "nowhere")], "id int, x double, few string, many string")
    rows = {r.id: r for r in s.transform_manual(batch, prep, ["id"], ["x_scaled", "few_b", "few_c", "many", "extra"]).collect()}
    names = sorted(f"city {i}" for i in range(25))
    assert (rows[1].few_b, rows[1].few_c, rows[1].many, rows[1].extra) == (1, 0, names.index("city 10"), 0)
    assert (rows[2].few_b, rows[2].many, rows[2].x_scaled) == (0, -1, None)
    flat = s.fit_manual(train.withColumn("x", F.lit(3.0)), ["x"], [])
    assert {r.x_scaled for r in s.transform_manual(batch.filter("id = 1"), flat).collect()} == {0.0}


def test_scores_and_bands(spark):
    df = spark.createDataFrame([(0.5,), (0.1,), (0.86,), (0.34,)], "p double")
    rows = {r.p: r for r in s.score_rows(df, "p", 0.5, "yes", "no").collect()}
    assert (rows[0.5].prediction, rows[0.5].confidence_label) == ("yes", "low")
    assert (rows[0.1].prediction, rows[0.1].confidence_label) == ("no", "high")
    assert rows[0.34].confidence_label == "moderate" and rows[0.86].probability_negative == 0.14
    row = s.batch_summary(s.score_rows(df, "p"), "p").first()
    assert (row.positive, row.negative, row.high_confidence, row.low_confidence) == (2, 2, 2, 2)


def test_contributions_and_text(spark):
    df = spark.createDataFrame([(1, 2.0, -3.0, 0.5)], "id int, a double, b double, c double")
    weights = {"a": 1.0, "b": 2.0, "c": 1.0}
    rows = s.contributions(df, "id", weights, 2).orderBy("rank").collect()
    assert [(r.feature, r.contribution, r.direction) for r in rows] == [("b", 6.0, "negative"), ("a", 2.0, "positive")]
    text = s.explanations(df.withColumn("p", F.lit("yes")), "id", weights, "p").first().explanation
    assert text == "Key factors supporting yes: a (2.0), c (0.5). Factors against: b (-3.0)."


def test_row_errors(spark):
    df = spark.range(1, 121).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("age"))
    checked = validate_rows(df, ["age"])
    errors = error_rows(checked, "row").collect()
    assert len(errors) == 50 and errors[0].row == 1 and good_rows(checked).count() == 60
    status = s.batch_status(checked).first()
    assert (status.total_records, status.failed_records, status.progress) == (120, 60, 100.0)


def test_split_is_stable_and_stratified(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") < 4990, "common").alias("y"))
    a = {r.id: r.split for r in s.split_rows(df, "id", "y").collect()}
    b = {r.id: r.split for r in s.split_rows(df.repartition(7, "id"), "id", "y").collect()}
    assert a == b and len(a) == 5000
    for part in (df.filter("y = 'rare'"), df.filter("y = 'common'")):
        ids = [r.id for r in part.collect()]
        assert sum(a[i] == "test" for i in ids) == pytest.approx(0.2 * len(ids), abs=1.5)


def test_no_task_gets_a_whole_class_to_split(spark):
    df = spark.range(40_000).select("id", F.when(F.col("id") % 40 == 0, "rare").otherwise("common").alias("y"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in s.split_rows(df, "id", "y").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40_000 and max(sizes) < 20_000  # of 8 tasks


@pytest.mark.parametrize("algorithm", ["LogisticRegression", "DecisionTreeClassifier", "LinearSVC"])
def test_fit_score_learns(spark, algorithm):
    df = spark.range(600).select((F.col("id") % 2).cast("int").alias("label"), ((F.col("id") * 37) % 100 / 100.0 + F.col("id") % 2 * 0.6).alias("x"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    out = s.fit_score(data, data, algorithm)
    assert auc_and_ap(score_counts(out, "label", "score")).first().auc > 0.7


def test_monitoring_small(spark):
    rows = [(i, f"2024-01-0{1 + i % 2} 0{i % 3}:10:00", "m", "single", "a", 0.45 if i < 6 else 0.9, 10.0, i == 11) for i in range(12)]
    log = spark.createDataFrame(rows, "id int, t string, model string, type string, prediction string, probability double, latency_ms double, failed boolean")
    log = log.withColumn("ts", F.to_timestamp("t"))
    stats = mon.monitoring_stats(log).first()
    assert (stats.total_predictions, stats.errors, stats.throughput) == (11, 1, 4.0)
    assert {r.alert for r in mon.alerts(log).collect()} == {"error_rate", "borderline"}
    assert mon.alerts(log.filter("id < 5")).count() == 0
    assert {r["range"]: r["count"] for r in mon.confidence_distribution(log).collect()} == {
        "0.0-0.2": 0, "0.2-0.4": 0, "0.4-0.6": 6, "0.6-0.8": 0, "0.8-1.0": 5}
    assert mon.hourly_trend(log).count() == 24 and mon.prediction_distribution(log, ["a", "b"]).count() == 2


def test_versions(spark):
    rows = [("m", 1, 0.5, "a"), ("m", 2, 0.9, "b"), ("m", 3, 0.9, "c"), ("m", 4, None, "d"), ("n", 5, None, "e")]
    log = spark.createDataFrame(rows, "model_id string, id int, accuracy double, algorithm string").withColumn(
        "created_at", F.timestamp_seconds(F.col("id")))
    out = {r.id: r for r in reg.version_history(log).collect()}
    assert out[3].best_algorithm == "b" and out[4].best_accuracy == 0.9 and out[4].is_current and not out[3].is_current
    assert out[4].version == "v4.0" and out[5].best_accuracy is None and out[5].version_number == 1
    state = {r.model_id: r for r in reg.registered_state(log).collect()}
    assert (state["m"].best_algorithm, state["m"].current_version, state["n"].best_algorithm) == ("b", "v4.0", None)


def test_jobs_and_pages(spark):
    jobs = spark.createDataFrame([(1, "p", "completed", 2.0), (2, "p", "failed", 4.0), (3, "q", "running", None)],
                                 "id int, pipeline_name string, status string, execution_time double")
    row = reg.job_statistics(jobs).first()
    assert (row.total_jobs, row.success_rate, row.average_execution_time) == (3, 0.5, 3.0)
    assert reg.job_statistics(jobs.limit(0)).first().success_rate == 0.0
    assert page_info(jobs.limit(0), 1, 20).first().totalPages == 1
    assert {r.pipeline_name: r.success_rate for r in reg.pipeline_performance(jobs).collect()} == {"p": 0.5, "q": 0.0}


def test_find_model_and_ranking(spark):
    report = spark.createDataFrame([("Ada Boost", 0.7, 81.0), ("SVC", 0.9, 0.8)], "Algorithm string, Train_Score double, Test_Score double")
    assert mon.find_model(report, "adaboost").first().Algorithm == "Ada Boost"
    rows = mon.deployed_models(report).orderBy("rank").collect()
    assert [(r.id, r.accuracy, r.status) for r in rows] == [("adaboost", 0.81, "active"), ("svc", 0.8, "available")]
    assert math.isclose(rows[0].accuracy, 0.81)


def test_importance_contributions_and_those_of_a_fitted_tree(spark):
    df = spark.createDataFrame([(1, 2.0, -1.0, 5), (2, None, 0.0, 6)], "k int, a double, b double, c int")
    got = [tuple(r) for r in s.importance_contributions(df, "k", {"b": 0.25, "a": 0.5, "c": 0.25}, 2).orderBy("k", "rank").collect()]
    assert got == [(1, 1, "a", 0.5, 50.0, "positive", "2.0"), (1, 2, "b", 0.25, 25.0, "negative", "-1.0"),
                   (2, 1, "a", 0.5, 50.0, "negative", None), (2, 2, "b", 0.25, 25.0, "negative", "0.0")]
    rows = spark.range(400).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 10 + F.col("id") % 3).cast("double").alias("good"), (F.col("id") % 7).cast("double").alias("noise"))
    tree = DecisionTreeClassifier(maxDepth=2).fit(VectorAssembler(inputCols=["noise", "good"], outputCol="features").transform(rows))
    told = s.model_importances(tree, ["noise", "good"])
    assert told["good"] > 0.9 and s.importance_contributions(rows.withColumn("k", F.lit(1)), "k", told, 1).first().feature == "good"

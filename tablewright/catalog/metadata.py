"""R: analytics over jobs, activities, models; T2/T3 on batches of log lines."""

from pyspark.sql import functions as F

from ..operators import logs
from ..operators import registry as reg
from ..session import scratch_path
from ..sources.readers import list_artifacts, read_summary
from .base import LINES_SQL, REPORT_SQL, log_lines, query, r, report, table, ts

# Events as activities, models, versions and jobs.
_ACT = ("event_id AS id, CAST(user_id % 7 AS VARCHAR(10)) AS project_id, CAST(user_id AS VARCHAR(20)) AS user_id, event_type AS action, "
        "CASE WHEN value > 20 THEN 'model' ELSE 'dataset' END AS entity_type, "
        "CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END AS details, ts AS created_at")
_ACT_SQL = f"(SELECT {_ACT} FROM events)"
_STATUS = ("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' "
           "ELSE 'pending' END")
_JOB_SQL = (f"(SELECT event_id AS id, concat('pipeline_', user_id % 5) AS pipeline_name, {_STATUS} AS status, "
            "value AS execution_time, ts AS created_at FROM events)")
_MODEL_STATE = "CASE event_id % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'draft' ELSE 'archived' END"
_MODEL_SQL = (f"(SELECT event_id AS id, CAST(user_id % 7 AS VARCHAR(10)) AS project_id, concat('Model ', event_type, ' ', event_id) AS name, "
              f"{_MODEL_STATE} AS status, event_id % 4 < 2 AS is_deployed, CASE WHEN value > 20 THEN 'Forest' ELSE NULL END AS best_algorithm, "
              "CASE WHEN event_id % 2 = 0 THEN 'credit risk' ELSE NULL END AS description, ts AS updated_at FROM events)")
_VERSION_SQL = ("(SELECT event_id AS id, user_id % 20 AS model_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value) END AS accuracy, "
                "event_type AS algorithm, ts AS created_at FROM events)")


def _from(spark, sf, relation):
    """The same relation in Spark: its text is valid there too."""
    events = table(spark, sf, "events")
    return spark.sql(f"SELECT * FROM {relation.replace('FROM events', 'FROM {events}')}", events=events)


def activities(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id AS id", "CAST(user_id % 7 AS STRING) AS project_id", "CAST(user_id AS STRING) AS user_id",
        "event_type AS action", "CASE WHEN value > 20 THEN 'model' ELSE 'dataset' END AS entity_type",
        "CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END AS details", "ts AS created_at")


@query("r1_list_activities", f"""
SELECT id, project_id, user_id, action, entity_type, {ts('created_at')} AS created_at,
  CASE WHEN id % 10 = 0 THEN NULL ELSE json_extract_string(details, '$.k') END AS k
FROM {_ACT_SQL} t WHERE project_id = '3' AND action = 'click' ORDER BY t.created_at DESC, id DESC LIMIT 10 OFFSET 5""")
def list_activities(spark, sf):
    rows = reg.list_activities(activities(spark, sf), 5, 10, project_id="3", action="click")
    return rows.withColumn("k", F.col("details")["k"]).drop("details")


@query("r2_activity_summary", f"""
SELECT CASE WHEN g = 3 THEN 'total' WHEN g = 1 THEN 'action' ELSE 'entity_type' END AS section,
  CASE WHEN g = 1 THEN action WHEN g = 2 THEN entity_type END AS value, total, {ts('last_at')} AS last_at FROM (
  SELECT action, entity_type, grouping(action, entity_type) AS g, count(*) AS total, max(created_at) AS last_at FROM {_ACT_SQL}
  WHERE project_id = '3' GROUP BY GROUPING SETS ((action), (entity_type), ()))""")
def summary(spark, sf):
    return reg.activity_summary(activities(spark, sf).filter("project_id = '3'"))


@query("r3_list_models", f"""
SELECT id, name, status, best_algorithm, {ts('updated_at')} AS updated_at,
  (SELECT count(*) FROM {_MODEL_SQL} WHERE project_id = '3' AND status = 'staging' AND (name ILIKE '%FOREST%' OR description ILIKE '%FOREST%' OR best_algorithm ILIKE '%FOREST%')) AS total
FROM {_MODEL_SQL} t WHERE project_id = '3' AND status = 'staging' AND (name ILIKE '%FOREST%' OR description ILIKE '%FOREST%' OR best_algorithm ILIKE '%FOREST%')
ORDER BY t.updated_at DESC, id DESC LIMIT 20 OFFSET 10""")
def models(spark, sf):
    return reg.list_models(_from(spark, sf, _MODEL_SQL), "3", "staging", "FOREST", 20, 10).select(
        "id", "name", "status", "best_algorithm", "updated_at", "total")


@query("r4_version_history", f"""
SELECT id, model_id, accuracy, algorithm, {ts('created_at')} AS created_at, version_number, concat('v', version_number, '.0') AS version,
  version_number = total AS is_current, best.a AS best_accuracy, best.g AS best_algorithm FROM (
  SELECT *, row_number() OVER w AS version_number, count(*) OVER (PARTITION BY model_id) AS total,
    max(CASE WHEN accuracy IS NOT NULL THEN {{'a': accuracy, 't': -epoch_us(created_at), 'g': algorithm}} END) OVER w AS best
  FROM {_VERSION_SQL} WINDOW w AS (PARTITION BY model_id ORDER BY created_at, id))""")
def versions(spark, sf):
    return reg.version_history(_from(spark, sf, _VERSION_SQL))


@query("r4_registered_state", f"""
SELECT model_id, count(*) AS total_versions, {ts('max(created_at)')} AS updated_at, max(accuracy) AS best_accuracy,
  arg_max(algorithm, {{'a': accuracy, 't': -epoch_us(created_at)}}) FILTER (WHERE accuracy IS NOT NULL) AS best_algorithm,
  concat('v', count(*), '.0') AS current_version FROM {_VERSION_SQL} GROUP BY model_id""")
def state(spark, sf):
    return reg.registered_state(_from(spark, sf, _VERSION_SQL))


@query("r5_registry_cards", f"""
SELECT count(*) AS total_models, count(*) FILTER (WHERE is_deployed) AS deployed, count(*) FILTER (WHERE status = 'production') AS production,
  count(*) FILTER (WHERE status = 'staging') AS staging, count(*) FILTER (WHERE status = 'draft') AS draft,
  count(*) FILTER (WHERE status = 'archived') AS archived FROM {_MODEL_SQL}""")
def cards(spark, sf):
    return reg.registry_cards(_from(spark, sf, _MODEL_SQL))


@query("r6_model_states", f"""
SELECT model_id, arg_max(status, {{'c': created_at, 'i': id}}) AS status, {ts('max(created_at)')} AS updated_at,
  arg_max(status, {{'c': created_at, 'i': id}}) IN ('production', 'staging') AS is_deployed
FROM (SELECT id, CAST(project_id AS INTEGER) AS model_id, status, updated_at AS created_at FROM {_MODEL_SQL}) GROUP BY model_id""")
def states(spark, sf):
    events = _from(spark, sf, _MODEL_SQL).selectExpr("id", "CAST(project_id AS INT) AS model_id", "status", "updated_at AS created_at")
    return reg.model_states(events)


@query("r7_training_results", f"""
WITH b AS (SELECT * FROM {REPORT_SQL} t ORDER BY t."Test_Score" DESC, "Algorithm" LIMIT 1)
SELECT "Algorithm" AS best_algorithm, {r('"Test_Score"')} AS best_accuracy, {r('"Train_Score"')} AS best_train_score, {r('"Test_Score"')} AS best_test_score,
  (SELECT count(*) FROM {REPORT_SQL}) AS algorithms FROM b""")
def training(spark, sf):
    rows = report(spark, sf)
    best = rows.orderBy(F.col("Test_Score").desc(), "Algorithm").limit(1).select(
        F.col("Algorithm").alias("best_model"), F.col("Test_Score").alias("best_score"))
    return reg.detect_training_results(rows, best)


_ARTIFACTS = """SELECT 'best_model' AS artifact_name, 'model' AS artifact_type, sum(strlen(o_orderpriority) + 1) AS size_bytes FROM orders
UNION ALL SELECT 'scalers', 'scaler', sum(strlen(c_name) + 1) FROM customer UNION ALL SELECT 'ranked_report', 'report', sum(strlen("Algorithm") + 1) FROM """ + REPORT_SQL + " t"


@query("r7_training_artifacts", f"""
WITH b AS (SELECT * FROM {REPORT_SQL} t ORDER BY t."Test_Score" DESC, "Algorithm" LIMIT 1), a AS ({_ARTIFACTS})
SELECT "Algorithm" AS best_algorithm, {r('"Test_Score"')} AS best_accuracy, (SELECT count(*) FROM {REPORT_SQL}) AS algorithms,
  (SELECT {r("avg((o_totalprice > 150000)::INT)")} FROM orders) AS accuracy, (SELECT count(*) FROM orders) AS evaluated_rows,
  (SELECT sum(size_bytes)::BIGINT FROM a) AS artifact_bytes, artifact_name, artifact_type, size_bytes::BIGINT AS size_bytes FROM b, a""")
def training_files(spark, sf):
    folder = scratch_path(spark, "training")
    rows, orders = report(spark, sf), table(spark, sf, "orders")
    for name, lines in (("best_model", orders.select("o_orderpriority")), ("scalers", table(spark, sf, "customer").select("c_name")),
                        ("ranked_report", rows.select("Algorithm"))):
        lines.write.text(f"{folder}/{name}")
    measured = scratch_path(spark, "evaluation")
    orders.agg(F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("accuracy"), F.count("*").alias("evaluated_rows")).write.json(measured)
    best = rows.orderBy(F.col("Test_Score").desc(), "Algorithm").limit(1).select(
        F.col("Algorithm").alias("best_model"), F.col("Test_Score").alias("best_score"))
    out = reg.detect_training_results(
        rows, best, reg.training_artifacts(list_artifacts(spark, folder), folder),
        read_summary(spark, measured, "accuracy double, evaluated_rows bigint"))
    return out.select("best_algorithm", "best_accuracy", "algorithms", "evaluation_metrics.*", "artifact_bytes", F.inline("artifacts"))


@query("r8_jobs_by_status", f"""
SELECT id, pipeline_name, {ts('created_at')} AS created_at FROM {_JOB_SQL} t WHERE status = 'failed' ORDER BY t.created_at DESC, id DESC LIMIT 50""")
def jobs(spark, sf):
    return reg.list_jobs(_from(spark, sf, _JOB_SQL), 50, status="failed").select("id", "pipeline_name", "created_at")


@query("r9_job_statistics", f"""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending') AS pending, {r('avg(execution_time)')} AS average_execution_time,
  {r("count(*) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status IN ('completed', 'failed'))::DOUBLE")} AS success_rate FROM {_JOB_SQL}""")
def job_statistics(spark, sf):
    return reg.job_statistics(_from(spark, sf, _JOB_SQL))


@query("r10_pipeline_performance", f"""
SELECT pipeline_name, count(*) AS total_executions, {r('avg(execution_time)')} AS average_time,
  {r("count(*) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status IN ('completed', 'failed'))::DOUBLE")} AS success_rate
FROM {_JOB_SQL} GROUP BY pipeline_name""")
def performance(spark, sf):
    return reg.pipeline_performance(_from(spark, sf, _JOB_SQL))


@query("r11_ranked_report", f"""
SELECT "Algorithm", {r('"Train_Score"')} AS "Train_Score", {r('"Test_Score"')} AS "Test_Score" FROM {REPORT_SQL} t
ORDER BY t."Test_Score" DESC, "Algorithm" LIMIT 10""")
def ranked(spark, sf):
    return reg.ranked_report(report(spark, sf), 10)


ALGOS = "('LogisticRegression', 'RandomForestClassifier', 'KMeans', 'LinearSVC')"
STATUS_SQL = rf"""(SELECT job, algorithm, max(position) FILTER (WHERE kind = 'started') AS last_start,
  min(position) FILTER (WHERE kind = 'completed') AS first_completed, min(position) FILTER (WHERE kind = 'failed') AS first_failed FROM (
  SELECT job, position, 'started' AS kind, regexp_extract(line, 'Training\s+(\w+)\.\.\.', 1) AS algorithm FROM {LINES_SQL} UNION ALL
  SELECT job, position, 'completed', regexp_extract(line, '✅\s+(\w+):\s+Train=', 1) FROM {LINES_SQL} UNION ALL
  SELECT job, position, 'failed', regexp_extract(line, '❌\s+(\w+)\s+failed', 1) FROM {LINES_SQL}) WHERE algorithm IN {ALGOS} GROUP BY job, algorithm)"""


@query("t2_running_algorithm", f"""
SELECT job, arg_max(algorithm, last_start) FILTER (WHERE first_completed IS NULL AND last_start IS NOT NULL) AS currently_running FROM {STATUS_SQL} GROUP BY job""")
def running(spark, sf):
    return logs.running_algorithm(logs.algorithm_status(log_lines(spark, sf)))


@query("t3_job_progress", f"""
SELECT job, arg_max(algorithm, last_start) FILTER (WHERE first_completed IS NULL AND last_start IS NOT NULL) AS currently_running,
  coalesce(string_agg(algorithm, '|' ORDER BY first_completed) FILTER (WHERE first_completed IS NOT NULL), '') AS completed,
  coalesce(string_agg(algorithm, '|' ORDER BY first_failed) FILTER (WHERE first_failed IS NOT NULL), '') AS failed,
  count(last_start) AS total, count(first_completed) AS completed_count, count(first_failed) AS failed_count,
  coalesce(round(count(first_completed) * 100 / nullif(count(last_start), 0)::DOUBLE, 1), 0) AS progress_percent FROM {STATUS_SQL} GROUP BY job""")
def progress(spark, sf):
    return logs.job_progress(logs.algorithm_status(log_lines(spark, sf)))

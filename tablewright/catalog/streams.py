"""T: the streaming operators, run over the events table until caught up."""

from pyspark.sql import functions as F

from ..operators.logs import job_progress
from ..session import scratch_path
from ..streaming import logs, monitoring
from .base import LINES_SQL, LOG_SQL, LINES, LOG, _split, query, r, table, ts
from .metadata import STATUS_SQL
from .scoring import HOURLY_SQL


def _events(spark, sf):
    return monitoring.stream_table(spark, sf, "events.parquet", table(spark, sf, "events"))


def _log(spark, sf):
    return _events(spark, sf).selectExpr(*_split(LOG))


def _lines(spark, sf):
    return _events(spark, sf).selectExpr(*_split(LINES)).withColumn("job", F.col("job").cast("string"))


def _paths(spark, label):
    folder = scratch_path(spark, label)
    return f"{folder}/out", f"{folder}/checkpoint"


@query("t1_tail_log_lines", rf"""
SELECT job, position, line, coalesce(nullif(regexp_extract(line, 'Training\s+(\w+)\.\.\.', 1), ''),
  nullif(regexp_extract(line, '✅\s+(\w+):\s+Train=', 1), '')) AS algorithm FROM {LINES_SQL}""")
def tail(spark, sf):
    out, checkpoint = _paths(spark, "tail")
    logs.tail_lines(_lines(spark, sf), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("t1_tail_log_files", rf"""
SELECT job, {ts('ts')} AS position, line, coalesce(nullif(regexp_extract(line, 'Training\s+(\w+)\.\.\.', 1), ''),
  nullif(regexp_extract(line, '✅\s+(\w+):\s+Train=', 1), '')) AS algorithm
FROM (SELECT job, ts, concat({ts('ts')}, ',000 - INFO - ', line) AS line FROM (SELECT {LINES}, ts FROM events))""")
def tail_files(spark, sf):
    # The events as text files, a folder for each job; the second half comes as new files after the first was read.
    out, checkpoint = _paths(spark, "tail")
    logs_at = scratch_path(spark, "logs")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - INFO - "), F.col("line"))
    lines = table(spark, sf, "events").selectExpr(*_split(LINES), "ts").select(F.col("job").cast("string").alias("job"), "position", text.alias("value"))
    for half in (0, 1):
        lines.filter(F.col("position") % 2 == half).select("job", "value").write.mode("append").partitionBy("job").text(logs_at)
        logs.tail_lines(logs.stream_log_lines(spark, logs_at), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("t3_streamed_progress", f"""
SELECT job, arg_max(algorithm, last_start) FILTER (WHERE first_completed IS NULL AND last_start IS NOT NULL) AS currently_running,
  count(last_start) AS total, count(first_completed) AS completed_count, count(first_failed) AS failed_count FROM {STATUS_SQL} GROUP BY job""")
def progress(spark, sf):
    out, checkpoint = _paths(spark, "status")
    logs.keep_status(_lines(spark, sf), out, checkpoint).awaitTermination()
    return job_progress(logs.read_status(spark, out, "bigint")).select(
        "job", "currently_running", "total", "completed_count", "failed_count")


@query("t4_hourly_stream", f"""
SELECT * FROM ({HOURLY_SQL}) WHERE window_start::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def hourly(spark, sf):
    out, checkpoint = _paths(spark, "hourly")
    monitoring.append_to(monitoring.hourly_stream(_log(spark, sf)), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("t5_alert_stream", f"""
SELECT window_start, 'error_rate' AS alert, 'warning' AS severity, concat('Error rate above 5%: ', errors, '/', predictions + errors, ' failed predictions') AS message
FROM ({HOURLY_SQL}) WHERE predictions + errors > 10 AND errors / (predictions + errors)::DOUBLE > 0.05
  AND window_start::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) UNION ALL
SELECT window_start, 'borderline', 'warning', concat('High proportion of borderline predictions (', borderline, ' in 0.4-0.6 range)')
FROM ({HOURLY_SQL}) WHERE predictions > 10 AND borderline / predictions::DOUBLE > 0.3
  AND window_start::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def alerts(spark, sf):
    out, checkpoint = _paths(spark, "alerts")
    monitoring.alert_stream(_log(spark, sf), out, checkpoint).awaitTermination()
    return monitoring.read_alerts(spark, out)


@query("t6_deduplicated_log", f"SELECT id, {ts('ts')} AS ts, prediction, {r('probability')} AS probability FROM {LOG_SQL}")
def deduplicated(spark, sf):
    out, checkpoint = _paths(spark, "dedup")
    log = _log(spark, sf)
    # Every row twice: the copies have the same id and time.
    doubled = log.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    monitoring.append_to(monitoring.deduplicated(doubled), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("id", "ts", "prediction", "probability")

"""Analytics over model, version, activity and job tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from .aggregate import count_statuses, counts_by_two_keys
from .projection import filter_equal, newest_first, search_text
from .ranking import running


def list_activities(activities: DataFrame, skip: int = 0, limit: int = 10, **wanted) -> DataFrame:
    """Newest activities matching the filters, with ``details`` parsed (bad JSON gives null)."""
    rows = newest_first(filter_equal(activities, **wanted), ["created_at", "id"], limit, skip)
    return rows.withColumn("details", F.from_json("details", "map<string,string>"))


def activity_summary(activities: DataFrame, action: str = "action", entity: str = "entity_type") -> DataFrame:
    """Counts by action, by entity and in total, with the latest time."""
    return counts_by_two_keys(activities, action, entity, "created_at")


def list_models(models: DataFrame, project: str | None = None, status: str | None = None,
                search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of registered models, latest update first, with the total before paging."""
    found = search_text(filter_equal(models, project_id=project, status=status), search,
                        ["name", "description", "best_algorithm"])
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return newest_first(found, ["updated_at", "id"], limit, offset).withColumn("total", total)


def registry_cards(models: DataFrame) -> DataFrame:
    """One row: total, deployed, production, staging, draft, archived."""
    return count_statuses(
        models.withColumn("deployed", F.col("is_deployed")), "status",
        ["production", "staging", "draft", "archived"], ["deployed"],
    ).withColumnRenamed("total", "total_models")


def version_history(log: DataFrame, model: str = "model_id", time: Sequence[str] = ("created_at", "id"),
                    metric: str = "accuracy", algorithm: str = "algorithm") -> DataFrame:
    """Number the versions of every model and carry the best metric so far.

    Adds version_number, version (``v3.0``), is_current (the newest),
    best_accuracy and best_algorithm up to that version; an equal metric does
    not replace an earlier one.  A model may own most of the log: numbering and
    running maximum work in buckets of a model, see ``running``.
    """
    rows = log.select("*", F.unix_micros(col(time[0]).cast("timestamp")).alias("_time"))
    rows = running(rows, [model], list(time), sums={"version_number": F.lit(1).cast("bigint")},
                   totals_of={"_versions": "version_number"}, maxima={
        "_best": F.when(col(metric).isNotNull(), F.struct(
            col(metric).alias("metric"), (-F.col("_time")).alias("early"), col(algorithm).alias("algorithm")))})
    return rows.select(
        *[col(c) for c in log.columns], "version_number",
        F.concat(F.lit("v"), F.col("version_number").cast("string"), F.lit(".0")).alias("version"),
        (F.col("version_number") == F.col("_versions")).alias("is_current"),
        F.col("_best.metric").alias("best_accuracy"), F.col("_best.algorithm").alias("best_algorithm"))


def registered_state(log: DataFrame, model: str = "model_id", time: str = "created_at", tie: str = "id",
                     metric: str = "accuracy", algorithm: str = "algorithm") -> DataFrame:
    """One row per model as the registry holds it: versions, latest time, best metric and algorithm.

    Algebraic, so partial aggregates do the work whatever a model's share of the log.
    """
    better = F.when(col(metric).isNotNull(), F.struct(
        col(metric).alias("m"), (-F.unix_micros(col(time).cast("timestamp"))).alias("t")))
    return log.groupBy(col(model)).agg(
        F.count(F.lit(1)).alias("total_versions"), F.max(time).alias("updated_at"), F.max(metric).alias("best_accuracy"),
        F.max_by(col(algorithm), better).alias("best_algorithm"),
    ).withColumn("current_version", F.concat(F.lit("v"), F.col("total_versions").cast("string"), F.lit(".0")))


def model_states(events: DataFrame, model: str = "model_id", status: str = "status",
                 time: Sequence[str] = ("created_at", "id"), deploys: Sequence[str] = ("production", "staging")) -> DataFrame:
    """Latest status per model from a log of promotions, deployments and archivings."""
    when = F.struct(*[col(c) for c in time])
    return events.groupBy(col(model)).agg(
        F.max_by(col(status), when).alias("status"), F.max(time[0]).alias("updated_at"),
    ).withColumn("is_deployed", F.col("status").isin(list(deploys)))


def list_jobs(jobs: DataFrame, limit: int = 50, **wanted) -> DataFrame:
    """Newest jobs, optionally of one status or pipeline."""
    return newest_first(filter_equal(jobs, **wanted), ["created_at", "id"], limit)


# Job states that are counted.
JOB_STATES = ["completed", "failed", "running", "pending"]


def job_statistics(jobs: DataFrame) -> DataFrame:
    """One row: jobs by state, share completed among finished, mean execution time."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), *[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATES],
        F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("average_execution_time"),
    ).withColumn("success_rate", ratio(F.col("completed"), F.col("completed") + F.col("failed")))


def pipeline_performance(jobs: DataFrame, pipeline: str = "pipeline_name") -> DataFrame:
    """Executions, mean time and success rate per pipeline."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return jobs.groupBy(col(pipeline)).agg(
        F.count(F.lit(1)).alias("total_executions"), F.avg("execution_time").alias("average_time"),
        ratio(done, done + failed).alias("success_rate"))


def ranked_report(report: DataFrame, top: int = 10) -> DataFrame:
    """The best algorithms of a report by test score."""
    return report.orderBy(F.col("Test_Score").desc(), "Algorithm").limit(top)


def best_row(report: DataFrame, summary: DataFrame) -> DataFrame:
    """The report row of the summary's best model, with the summary's score."""
    names = summary.select(F.col("best_model").alias("_best"), F.col("best_score"))
    return report.join(names, F.col("Algorithm") == F.col("_best")).drop("_best")


def training_artifacts(files: DataFrame, folder: str) -> DataFrame:
    """Artifact, its type and bytes from ``list_artifacts`` of ``folder``; a folder of part files is one artifact."""
    inside = F.split(F.col("file_path"), f"/{re.escape(folder.rstrip('/').rsplit('/', 1)[-1])}/", 2)[1]
    name = F.split(inside, "/")[0]
    kind = F.when(name.startswith("best_model"), "model").when(name.startswith("scaler"), "scaler").otherwise("report")
    return files.groupBy(name.alias("artifact_name")).agg(F.first(kind).alias("artifact_type"), F.sum("file_size_bytes").alias("size_bytes"))


def detect_training_results(report: DataFrame, summary: DataFrame, artifacts: DataFrame | None = None,
                            metrics: DataFrame | None = None) -> DataFrame:
    """One row on a finished training: best algorithm and its scores, algorithms compared, metrics, artifacts.

    ``artifacts`` is ``training_artifacts`` of the output folder: its rows come
    as an array by name, with their bytes summed.  ``metrics`` is an evaluation
    file of one row, whose columns are taken over.
    """
    algorithms = report.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = best_row(report, summary).select(
        F.col("Algorithm").alias("best_algorithm"), F.col("best_score").alias("best_accuracy"),
        F.col("Train_Score").alias("best_train_score"), F.col("Test_Score").alias("best_test_score"),
        algorithms.alias("algorithms"))
    if metrics is not None:
        out = out.select("*", F.struct(*[metrics.select(col(m)).scalar().alias(m) for m in metrics.columns]).alias("evaluation_metrics"))
    if artifacts is not None:
        listed = F.array_sort(F.collect_list(F.struct("artifact_name", "artifact_type", "size_bytes")))
        out = out.withColumn("artifacts", artifacts.agg(listed.alias("a")).scalar())
        out = out.withColumn("artifact_bytes", F.aggregate("artifacts", F.lit(0).cast("bigint"), lambda t, a: t + a["size_bytes"]))
    return out

"""Prediction history, monitoring and alerts over a prediction log.

A log has: id, ts, model, type, prediction, probability, latency_ms, failed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import name_frame, ratio
from ..functions.text import model_id
from .projection import filter_equal, page

# Confidence ranges, as lower bound and name.
BUCKETS = [(0.0, "0.0-0.2"), (0.2, "0.2-0.4"), (0.4, "0.4-0.6"), (0.6, "0.6-0.8"), (0.8, "0.8-1.0")]


def bucket_name(p: Column) -> Column:
    out = F.when(p < 0.2, BUCKETS[0][1])
    for bound, (_, name) in zip((0.4, 0.6, 0.8), BUCKETS[1:4]):
        out = out.when(p < bound, name)
    return out.when(p.isNotNull(), BUCKETS[4][1])


def prediction_history(log: DataFrame, kind: str | None = None, model: str | None = None,
                       number: int = 1, size: int = 20) -> DataFrame:
    """One page of the history, newest first, optionally of one type or model."""
    return page(filter_equal(log, type=kind, model=model), [F.col("ts").desc(), F.col("id")], number, size)


def monitoring_stats(log: DataFrame) -> DataFrame:
    """One row: predictions, mean latency, error rate, predictions per active hour of day.

    Hours are hours of the day, so several days fall together; ``hourly_windows``
    keeps them apart.
    """
    ok = ~F.col("failed")
    return log.agg(
        F.count_if(ok).alias("total_predictions"), F.count_if(F.col("failed")).alias("errors"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("_latency"),
        F.size(F.collect_set(F.when(ok, F.hour("ts")))).alias("_hours"),
    ).select(
        "total_predictions", "errors", F.round(F.coalesce("_latency", F.lit(0.0)), 1).alias("average_latency_ms"),
        F.round(ratio(F.col("errors"), F.col("errors") + F.col("total_predictions")), 4).alias("error_rate"),
        F.round(F.col("total_predictions") / F.greatest("_hours", F.lit(1)), 0).alias("throughput"))


def confidence_distribution(log: DataFrame) -> DataFrame:
    """Five ranges with their counts, empty ones included."""
    counted = log.filter("NOT failed AND probability IS NOT NULL").groupBy(
        bucket_name(F.col("probability")).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    frame = name_frame(log.sparkSession, [{"range": name} for _, name in BUCKETS])
    return frame.join(counted, F.col("range") == F.col("_b"), "left").select(
        "range", F.coalesce("n", F.lit(0)).alias("count"))


def prediction_distribution(log: DataFrame, classes: Sequence[str] = ()) -> DataFrame:
    """Successful predictions per class; the given classes appear even when empty."""
    counted = log.filter("NOT failed").groupBy(F.col("prediction").alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    if not classes:
        return counted.select(F.col("_p").alias("prediction"), F.col("n").alias("count"))
    frame = name_frame(log.sparkSession, [{"prediction": c} for c in classes])
    return frame.join(counted, F.col("prediction") == F.col("_p"), "left").select(
        "prediction", F.coalesce("n", F.lit(0)).alias("count"))


def hourly_trend(log: DataFrame) -> DataFrame:
    """24 rows: predictions and mean probability per hour of the day."""
    counted = log.filter("NOT failed").groupBy(F.hour("ts").alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("probability").alias("s"))
    hours = log.sparkSession.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counted, F.col("hour") == F.col("_h"), "left").select(
        "hour", F.coalesce("n", F.lit(0)).alias("predictions"),
        F.round(ratio(F.coalesce("s", F.lit(0.0)), F.col("n")), 3).alias("avg_confidence"))


def hourly_windows(log: DataFrame) -> DataFrame:
    """Statistics per clock hour; the same expression serves a stream."""
    return log.groupBy(F.window("ts", "1 hour").alias("w")).agg(*window_aggregates()).select(
        F.col("w.start").alias("window_start"), *window_columns())


def window_aggregates() -> list[Column]:
    ok = ~F.col("failed")
    p = F.col("probability")
    return [
        F.count_if(ok).alias("predictions"), F.count_if(F.col("failed")).alias("errors"),
        F.sum(F.when(ok, p)).alias("_p"), F.count_if(ok & (p >= 0.4) & (p < 0.6)).alias("borderline"),
    ]


def window_columns() -> list[Column]:
    return [F.col("predictions"), F.col("errors"), F.col("borderline"),
            ratio(F.col("_p"), F.col("predictions")).alias("mean_probability"),
            ratio(F.col("errors"), F.col("errors") + F.col("predictions")).alias("error_rate")]


def alert_rows(stats: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Alerts of rows that hold predictions, errors and borderline counts.

    More than 10 requests and over 5 % errors; more than 10 predictions and
    over 30 % of them between 0.4 and 0.6.
    """
    n, bad, mid = F.col("predictions"), F.col("errors"), F.col("borderline")
    many_errors = (n + bad > 10) & (ratio(bad, n + bad) > 0.05)
    many_mid = (n > 10) & (ratio(mid, n) > 0.3)
    found = F.array_compact(F.array(
        F.when(many_errors, F.struct(
            F.lit("error_rate").alias("alert"), F.lit("warning").alias("severity"),
            F.format_string("Error rate above 5%%: %d/%d failed predictions", bad, n + bad).alias("message"))),
        F.when(many_mid, F.struct(
            F.lit("borderline").alias("alert"), F.lit("warning").alias("severity"),
            F.format_string("High proportion of borderline predictions (%d in 0.4-0.6 range)", mid).alias("message")))))
    return stats.select(*keep, F.inline(found))


def alerts(log: DataFrame) -> DataFrame:
    """Alerts over the whole log."""
    return alert_rows(log.agg(*window_aggregates()))


def deployed_models(report: DataFrame) -> DataFrame:
    """Models by accuracy on a 0-1 scale, best first; the first is active.

    A report has one row per algorithm, so the ranking window is small.
    """
    score = F.when(F.col("Test_Score") > 1, F.col("Test_Score") / 100).otherwise(F.col("Test_Score"))
    order = Window.orderBy(F.col("accuracy").desc(), "algorithm")
    return report.select(
        model_id(F.col("Algorithm"), "").alias("id"), F.col("Algorithm").alias("algorithm"), F.round(score, 4).alias("accuracy"),
    ).withColumn("rank", F.row_number().over(order)).withColumn(
        "status", F.when(F.col("rank") == 1, "active").otherwise("available"))


def find_model(report: DataFrame, wanted: str | None) -> DataFrame:
    """The report row of a model: the best one, or by name ignoring case and blanks."""
    if wanted in (None, "best"):
        return report.orderBy(F.col("Test_Score").desc(), "Algorithm").limit(1)
    plain = F.lower(F.regexp_replace("Algorithm", " ", ""))
    return report.filter(plain == wanted.lower().replace(" ", ""))

"""Prediction logs as a stream: deduplication, hourly statistics, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.monitoring import alert_rows, window_aggregates, window_columns
from .snapshots import SnapshotTable


def stream_table(spark: SparkSession, folder: str, pattern: str, like: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of ``like``."""
    return (
        spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def _with_watermark(log: DataFrame, late: str) -> DataFrame:
    """Event time is ``ts``; a timestamp without zone is read in the session's zone."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def deduplicated(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each prediction id once; ids are remembered until the watermark passes them."""
    return _with_watermark(log, late).dropDuplicatesWithinWatermark(["id"])


def hourly_stream(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Statistics per clock hour, sent once the hour can no longer change.

    Rows later than ``late`` behind the newest are dropped.  Aggregation is
    partial before the shuffle, so one busy hour is not one task's work.
    """
    return (
        _with_watermark(log, late).groupBy(F.window("ts", "1 hour").alias("w")).agg(*window_aggregates())
        .select(F.col("w.start").alias("window_start"), *window_columns())
    )


def append_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table, exactly once; stops when caught up."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def alert_table(out: str, every: int = 10) -> SnapshotTable:
    """The alerts kept under ``out``: an hour is closed once, so no two batches hold the same alert."""
    return SnapshotTable(out, "window_start timestamp, alert string, severity string, message string", every=every)


def alert_stream(log: DataFrame, out: str, checkpoint: str, late: str = "1 hour", every: int = 10) -> StreamingQuery:
    """Alerts per closed hour, in a table whose batches are merged every ``every`` epochs."""
    kept = alert_table(out, every)

    def write(batch: DataFrame, epoch: int) -> None:
        kept.write(alert_rows(batch, keep=["window_start"]), epoch)

    return (
        hourly_stream(log, late).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    return alert_table(out).read(spark)

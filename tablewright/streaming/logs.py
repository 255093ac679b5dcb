"""Training logs as a stream: new lines tagged, algorithm status kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import algorithm_aggregates, line_events, tag_lines
from .snapshots import SnapshotTable


def stream_log_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of new files under ``path``: job (folder ``job=...``, else the file's name without ending), position, line.

    A file is read once, when it is there; a log that goes on is rotated into new files.

    A stream has no line numbers; ``position`` is the time a record starts with
    (``2025-01-31 12:00:00,123 - INFO - ...``), null without one.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/job=([^/]+)/", 1)
    stamp = F.regexp_extract("value", r"^\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})", 1)
    return lines.select(
        F.coalesce(F.nullif(folder, F.lit("")), name).alias("job"),
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("position"),
        F.trim("value").alias("line"))


def tail_lines(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every tagged line to a parquet table, exactly once; stops when caught up."""
    return (
        tag_lines(lines).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


_MERGED = "job string, algorithm string, last_start {0}, first_completed {0}, first_failed {0}"


def status_table(out: str, every: int = 10, position: str = "timestamp") -> SnapshotTable:
    """The kept status under ``out``: starts only grow and firsts only shrink, so rows of any age can be merged."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("job", "algorithm").agg(
            F.max("last_start").alias("last_start"), F.min("first_completed").alias("first_completed"),
            F.min("first_failed").alias("first_failed"))

    return SnapshotTable(out, _MERGED.format(position), merge, every)


def keep_status(lines: DataFrame, out: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """Keep start, completion and failure positions per (job, algorithm).

    State is one small row per known algorithm of a job.  Each batch writes its
    changed rows; every ``every`` batches they become one snapshot, so the
    folder stays small however long the stream runs.
    """
    changed = line_events(lines).groupBy("job", "algorithm").agg(*algorithm_aggregates())
    kept = status_table(out, every, lines.schema["position"].dataType.simpleString())
    return (
        changed.writeStream.outputMode("update").foreachBatch(kept.write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_status(spark: SparkSession, out: str, position: str = "timestamp") -> DataFrame:
    """Current status: the newest snapshot and the batches after it."""
    return status_table(out, position=position).read(spark)

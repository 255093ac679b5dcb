"""Training logs: which algorithm runs, what is done, how far the job is.

Input rows: job, position (orders the lines of a job), line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.text import (
    algorithm_in_line, completed_algorithm, failed_algorithm, known, started_algorithm,
)


def tag_lines(lines: DataFrame) -> DataFrame:
    """Every non-blank line with the algorithm it names (null when none)."""
    return lines.filter(F.trim("line") != "").withColumn("algorithm", algorithm_in_line(F.col("line")))


def line_events(lines: DataFrame) -> DataFrame:
    """One row per start, completion or failure of a known algorithm."""
    line = F.col("line")
    kinds = {"started": started_algorithm(line), "completed": completed_algorithm(line), "failed": failed_algorithm(line)}
    events = F.array(*[F.struct(F.lit(k).alias("kind"), known(a).alias("algorithm")) for k, a in kinds.items()])
    return lines.select("job", "position", F.inline(events)).filter("algorithm IS NOT NULL")


def algorithm_aggregates() -> list[Column]:
    """Per (job, algorithm): last start, first completion, first failure.  Fit for batch and stream."""
    def at(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("position"))

    return [F.max(at("started")).alias("last_start"), F.min(at("completed")).alias("first_completed"),
            F.min(at("failed")).alias("first_failed")]


def algorithm_status(lines: DataFrame) -> DataFrame:
    """Per job and algorithm: last start, first completion and first failure position."""
    return line_events(lines).groupBy("job", "algorithm").agg(*algorithm_aggregates())


def running_algorithm(status: DataFrame) -> DataFrame:
    """Per job the newest started algorithm without completion (null when all are done)."""
    open_start = F.when(F.col("first_completed").isNull(), F.col("last_start"))
    return status.groupBy("job").agg(F.max_by("algorithm", open_start).alias("currently_running"))


def job_progress(status: DataFrame) -> DataFrame:
    """Per job: running algorithm, completed and failed in first-seen order, counts, progress.

    ``status`` has at most one row per known algorithm and job, so the lists
    are short.
    """
    def in_order(at: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(
            F.col(at).isNotNull(), F.struct(F.col(at).alias("p"), F.col("algorithm").alias("a")))))
        return F.transform(found, lambda s: s["a"])

    total = F.count("last_start")
    done = F.count("first_completed")
    return status.groupBy("job").agg(
        F.max_by("algorithm", F.when(F.col("first_completed").isNull(), F.col("last_start"))).alias("currently_running"),
        in_order("first_completed").alias("completed"), in_order("first_failed").alias("failed"),
        total.alias("total"), done.alias("completed_count"), F.count("first_failed").alias("failed_count"),
        F.round(ratio(done * 100, total), 1).alias("progress_percent"))

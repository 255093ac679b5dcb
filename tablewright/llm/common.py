"""What the corpus operators share: reading tables, written intermediates, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def corpus(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame under the shared checkpoint folder and read it back.

    Cuts lineage in a way that survives the loss of any executor, and lets
    several later steps read the rows without computing them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch holds, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def portions(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``size`` bytes together."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)

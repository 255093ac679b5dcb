"""Sinks.  Writes stay partitioned: one file per task, never one file in all."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .readers import read_csv


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; blanks and line breaks at the ends of a text are kept."""
    df.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(kind)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write as CSV and read back with the same column types."""
    write_csv(df, path)
    return read_csv(df.sparkSession, path, schema=df.schema)

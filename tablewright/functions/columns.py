"""Small building blocks shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0 or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def share(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the bottom is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def name_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A few rows of configuration as a DataFrame, built inside the JVM."""
    structs = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in row.items()])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))

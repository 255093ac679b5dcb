"""Profiles and data quality.  Per-column work runs on (column, value) cells,
so one shuffle serves all columns however many there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, name_frame, quoted
from ..plans.schema import columns_by_kind, display_type, key_cells, kind_of, numeric_cells, numeric_columns, text_cells
from .aggregate import duplicate_counts
from .ranking import column_quantiles

# Date shapes tried on sample values, besides ISO.
_DATE_FORMATS = ["yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy"]


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, n), null counted as a value."""
    return text_cells(df, list(columns)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _column_rows(df: DataFrame) -> DataFrame:
    """One row per column of the schema, also for an empty table."""
    return name_frame(df.sparkSession, [
        {"position": i, "name": f.name, "dtype": f.dataType.simpleString(),
         "display_type": display_type(f.dataType), "kind": kind_of(f.dataType)}
        for i, f in enumerate(df.schema.fields)
    ])


def column_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct present values.

    Exact distinct counts shuffle every distinct cell once; ``approx`` counts
    them by sketch and shuffles one row per task.
    """
    if approx:
        return text_cells(df).groupBy("column").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"),
            F.approx_count_distinct("value", 0.01).alias("unique_count"))
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, row_count bigint, null_count bigint, unique_count bigint")
    counted = key_cells(df, df.columns).groupBy("_i", "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in df.columns])
    return counted.groupBy("_i").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("_a").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("_a").alias("unique_count"),
    ).select(F.get(names, F.col("_i")).alias("column"), "row_count", "null_count", "unique_count")


def introspect(df: DataFrame, order_by: Sequence[str] | None = None, sample_size: int = 0,
               approx: bool = False) -> DataFrame:
    """Column metadata: types, nulls, distinct values, whether it could be a key.

    With ``approx`` the distinct counts are estimates (1 %), and so is the key
    flag: a column within 3 % of the row count could be a key.

    With ``sample_size`` the first present values by ``order_by`` are added as
    JSON texts, and text columns whose first 20 values are all dates show DATE.
    """
    columns = _column_rows(df)
    unique, rows = F.coalesce("unique_count", F.lit(0)), F.coalesce("row_count", F.lit(0))
    could_be_key = unique >= rows * 0.97 if approx else unique == rows
    out = columns.join(column_counts(df, approx), F.col("name") == F.col("column"), "left").select(
        "position", "name", "dtype", "display_type",
        (F.coalesce("null_count", F.lit(0)) > 0).alias("nullable"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.coalesce("null_count", F.lit(0)).alias("null_count"),
        F.coalesce(F.round(F.try_divide(F.col("null_count") * 100.0, F.col("row_count")), 2), F.lit(0.0))
        .alias("null_percentage"),
        could_be_key.alias("is_potential_key"),
    )
    if not sample_size:
        return out
    firsts = first_values(df, order_by, max(sample_size, 20))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    dated = F.forall("firsts", lambda v: _is_date(v))
    out = out.join(firsts.withColumnRenamed("column", "_c"), F.col("name") == F.col("_c"), "left")
    return out.withColumn(
        "display_type",
        F.when(F.col("name").isin(texts) & (F.size("firsts") > 0) & dated, "DATE").otherwise(F.col("display_type")),
    ).withColumn(
        "sample_values", F.to_json(F.slice(F.coalesce("firsts", F.array().cast("array<string>")), 1, sample_size))
    ).drop("_c", "firsts")


def _is_date(value: Column) -> Column:
    parsed = F.try_to_timestamp(value)
    for fmt in _DATE_FORMATS:
        parsed = F.coalesce(parsed, F.try_to_timestamp(value, F.lit(fmt)))
    return parsed.isNotNull()


def first_values(df: DataFrame, order_by: Sequence[str] | None, n: int) -> DataFrame:
    """Per column the first n present values as texts, in row order.

    The rank filter becomes a group limit ahead of the shuffle: a task sends at
    most n cells per column.
    """
    if order_by:
        order = F.struct(*[col(c) for c in order_by])
    else:
        order = F.monotonically_increasing_id()
    rows = df.select(order.alias("_order"), *[col(c).cast("string").alias(c) if not isinstance(
        df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(col(c)).alias(c)
        for c in df.columns])
    cells = rows.unpivot(["_order"], [quoted(c) for c in df.columns], "column", "value").filter("value IS NOT NULL")
    ranked = cells.withColumn("_rank", F.row_number().over(Window.partitionBy("column").orderBy("_order")))
    return ranked.filter(F.col("_rank") <= n).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda s: s["value"]).alias("firsts"))


def summary(df: DataFrame) -> DataFrame:
    """One row: shape, columns by kind and an estimate of the bytes held."""
    kinds = columns_by_kind(df)
    widths = F.lit(0)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            widths = widths + F.coalesce(F.octet_length(col(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            widths = widths + F.coalesce(F.octet_length(F.to_json(col(f.name))), F.lit(0))
        else:
            widths = widths + F.lit(4 if isinstance(f.dataType, (T.IntegerType, T.FloatType, T.DateType)) else 8)
    names = {k: F.array(*[F.lit(c) for c in v]).cast("array<string>").alias(k) for k, v in kinds.items()}
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum(widths.cast("bigint")), F.lit(0)).alias("estimated_bytes"),
    ).select("total_rows", F.lit(len(df.columns)).alias("total_columns"), "estimated_bytes", *names.values())


def _missing_total(df: DataFrame) -> Column:
    total = F.lit(0)
    for c in df.columns:
        total = total + F.count_if(col(c).isNull())
    return total


def dataset_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and share, duplicates, columns by kind."""
    kinds = columns_by_kind(df)
    duplicates = duplicate_counts(df).select("duplicates")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), _missing_total(df).alias("missing_values")).select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"), "missing_values",
        F.round(F.try_divide(F.col("missing_values") * 100.0, F.col("total_rows") * len(df.columns)), 2)
        .alias("missing_percentage"),
        duplicates.scalar().alias("duplicates"),
        *[F.lit(len(kinds[k])).alias(f"{k}_cols") for k in ("numeric", "categorical", "datetime")],
    )


def column_info(df: DataFrame) -> DataFrame:
    """Per column: type, kind, missing, distinct values with null as a value (null for numbers)."""
    counts = column_counts(df)
    seen = F.coalesce("unique_count", F.lit(0)) + F.when(F.col("null_count") > 0, 1).otherwise(0)
    return _column_rows(df).join(counts, F.col("name") == F.col("column"), "left").select(
        "name", "dtype", F.col("kind").alias("type"), F.coalesce("null_count", F.lit(0)).alias("missing"),
        F.when(F.col("kind") != "numeric", seen).alias("unique_values"),
    )


# Quantiles reported for a numeric column.
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column the aggregates every report shares; one pass, map-side partials.

    Skewness and kurtosis are null for a constant column.
    """
    v = F.col("value")
    varies = F.max(v) > F.min(v)
    return numeric_cells(df, None if columns is None else list(columns)).groupBy("column").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_samp"),
        F.stddev_pop(v).alias("std_pop"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(varies, F.skewness(v)).alias("skewness"), F.when(varies, F.kurtosis(v)).alias("kurtosis"),
    )


def numeric_statistics(df: DataFrame, approx: bool = False) -> DataFrame:
    """Count, mean, median, std, min, max, quartiles and missing per numeric column.

    ``approx`` takes the quantiles from a sketch.
    """
    names = numeric_columns(df)
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    quantiles = column_quantiles(df, QUARTILES, names, approx)
    base = _column_rows(df).filter("kind = 'numeric'").select(F.col("name").alias("column"))
    out = base.join(moments(df, names), "column", "left").join(quantiles, "column", "left")
    return out.select(
        "column", F.coalesce("n", F.lit(0)).alias("count"), "mean", "median", F.col("std_samp").alias("std"),
        "min", "max", "q25", "q75", (rows.scalar() - F.coalesce("n", F.lit(0))).alias("missing"),
    )


def categorical_statistics(df: DataFrame) -> DataFrame:
    """Distinct values, most frequent one (smallest on ties), its count, missing, per text column."""
    names = columns_by_kind(df)["categorical"]
    return _value_counts_text(df, names).groupBy("column").agg(
        F.count("value").alias("unique"),
        F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value")))["value"].alias("top"),
        F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("freq"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
    )


def _value_counts_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts by whole text, since the values themselves are reported."""
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    cells = df.select(*[col(c) for c in names]).unpivot([], [quoted(c) for c in names], "column", "value")
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def missing_values(df: DataFrame) -> DataFrame:
    """Columns that have nulls: how many and which share (2 digits)."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count_if(col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    rows = counted.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("count")) for i, c in enumerate(df.columns)
    ])))
    return rows.filter("count > 0").select(
        "column", "count", F.round(F.col("count") / F.col("_rows") * 100, 2).alias("percent"))


def _quality_inputs(df: DataFrame) -> DataFrame:
    duplicates = duplicate_counts(df).select("duplicates")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), _missing_total(df).alias("missing_values_count")).select(
        "total_rows", (F.col("total_rows") * len(df.columns)).alias("total_cells"), "missing_values_count",
        duplicates.scalar().alias("duplicate_rows"),
    ).withColumn(
        "_complete", F.coalesce(100 - F.try_divide(F.col("missing_values_count") * 100.0, F.col("total_cells")), F.lit(100.0))
    ).withColumn(
        "_unique", F.coalesce((1 - F.try_divide(F.col("duplicate_rows") * 1.0, F.col("total_rows"))) * 100, F.lit(100.0))
    )


def quality_report(df: DataFrame) -> DataFrame:
    """One row: completeness, uniqueness and their mean."""
    return _quality_inputs(df).select(
        F.round((F.col("_complete") + F.col("_unique")) / 2, 2).alias("overall_quality_score"),
        F.round("_complete", 2).alias("completeness"), F.round("_unique", 2).alias("uniqueness"),
        "duplicate_rows", "missing_values_count", "total_cells",
    )


def quality_checks(df: DataFrame) -> DataFrame:
    """Two check rows: completeness PASS/WARNING/FAIL, uniqueness PASS/WARNING."""
    c, u = F.col("_complete"), F.col("_unique")
    checks = F.array(
        F.struct(
            F.lit("Data Completeness").alias("name"),
            F.when(c >= 95, "PASS").when(c >= 80, "WARNING").otherwise("FAIL").alias("status"),
            F.round(c, 2).alias("score"),
            F.format_string("%.1f%% of data is complete", c).alias("message")),
        F.struct(
            F.lit("Data Uniqueness").alias("name"),
            F.when(u >= 99, "PASS").otherwise("WARNING").alias("status"),
            F.round(u, 2).alias("score"),
            F.format_string("%d duplicate rows found", F.col("duplicate_rows")).alias("message")),
    )
    return _quality_inputs(df).select(F.inline(checks))


def dataset_quality(df: DataFrame, consistency: float = 100.0) -> DataFrame:
    """One row: the score as the mean of completeness, uniqueness and a given consistency."""
    return _quality_inputs(df).select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"), "duplicate_rows",
        (100 - F.col("_complete")).alias("missing_percentage"), F.col("_complete").alias("completeness"),
        F.col("_unique").alias("uniqueness"), F.lit(consistency).alias("consistency"),
        F.round((F.col("_complete") + F.col("_unique") + consistency) / 3, 2).alias("overall_quality_score"),
    )


def column_quality(df: DataFrame) -> DataFrame:
    """Per column: type, missing count and share, distinct present values."""
    return _column_rows(df).join(column_counts(df), F.col("name") == F.col("column"), "left").select(
        "name", F.col("dtype").alias("data_type"), F.coalesce("null_count", F.lit(0)).alias("missing_count"),
        F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("row_count")), F.lit(0.0)).alias("missing_percentage"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
    )


def phase_one(df: DataFrame) -> dict[str, DataFrame]:
    """Summary, statistics and quality of a dataset, each part lazy."""
    return {
        "summary": summary(df), "numeric_statistics": numeric_statistics(df),
        "categorical_statistics": categorical_statistics(df), "missing_values": missing_values(df),
        "duplicates": duplicate_counts(df), "quality_report": quality_report(df), "quality_checks": quality_checks(df),
    }

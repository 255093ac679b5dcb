"""Selections, filters, row validation, paging and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..plans.schema import columns_by_kind


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Only the numeric, categorical, datetime or other columns."""
    return df.select(*[col(c) for c in columns_by_kind(df)[kind]])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names absent from the table are ignored."""
    return df.select(*[col(c).alias(names.get(c, c)) for c in df.columns])


def handle_missing(df: DataFrame, how: str = "keep") -> DataFrame:
    """``keep``, ``drop_rows`` (any null) or ``fill_zero`` (numbers only)."""
    if how == "keep":
        return df
    if how == "drop_rows":
        return df.na.drop("any")
    if how == "fill_zero":
        numbers = set(columns_by_kind(df)["numeric"])
        types = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*[
            F.coalesce(col(c), F.lit(0).cast(types[c])).alias(c) if c in numbers else col(c) for c in df.columns
        ])
    raise ValueError(f"unknown handle_missing '{how}'")


def filter_equal(df: DataFrame, **wanted) -> DataFrame:
    """AND of column = value for every value given (None and "all" mean no filter)."""
    for name, value in wanted.items():
        if value is not None and value != "all":
            df = df.filter(col(name) == F.lit(value))
    return df


def search_text(df: DataFrame, term: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns holds the term, ignoring case."""
    if not term:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(col(c).ilike(f"%{term}%"), F.lit(False))
    return df.filter(hit)


def validate_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add ``error``: the first required field a row lacks, null for a good row."""
    error = F.lit(None).cast("string")
    for c in reversed(required):
        error = F.when(col(c).isNull(), F.lit(f"Missing required field: {c}")).otherwise(error)
    return df.withColumn("error", error)


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("error IS NULL").drop("error")


def error_rows(validated: DataFrame, row: str, keep: int = 50) -> DataFrame:
    """The first ``keep`` errors by row number, as the batch report shows them."""
    return (
        validated.filter("error IS NOT NULL").select(col(row).alias("row"), "error")
        .orderBy("row").limit(keep)
    )


def rule_violations(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Violations of a feature schema, one row per rule, in one pass.

    A rule is ``{"column": ..., "required": bool, "min": x, "max": y,
    "options": [...]}`` with any of the last four.
    """
    checks: list[tuple[str, str, Column]] = []
    for rule in rules:
        value = col(rule["column"])
        if rule.get("required"):
            checks.append((rule["column"], "required", value.isNull()))
        if rule.get("min") is not None:
            checks.append((rule["column"], "min", value < F.lit(rule["min"])))
        if rule.get("max") is not None:
            checks.append((rule["column"], "max", value > F.lit(rule["max"])))
        if rule.get("options") is not None:
            checks.append((rule["column"], "options", ~value.isin(list(rule["options"]))))
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.coalesce(test, F.lit(False))).alias(f"_c{i}") for i, (_, _, test) in enumerate(checks)],
    )
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("rule"),
                 F.col(f"_c{i}").alias("violations"), F.col("_rows").alias("total_rows"))
        for i, (c, kind, _) in enumerate(checks)
    ])))


def align_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the expected columns in order; a missing one is 0, others go."""
    have = set(df.columns)
    return df.select(*[(col(c) if c in have else F.lit(0)).alias(c) for c in expected])


def newest_first(df: DataFrame, by: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """One slice of the table ordered by ``by`` descending."""
    return df.orderBy(*[col(c).desc() for c in by]).offset(offset).limit(limit)


def page(df: DataFrame, order_by: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order_by).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: page, pageSize, totalItems, totalPages (at least 1)."""
    return df.agg(F.count(F.lit(1)).alias("totalItems")).select(
        F.lit(number).alias("page"), F.lit(size).alias("pageSize"), "totalItems",
        F.greatest(F.lit(1), F.ceil(F.col("totalItems") / size)).cast("bigint").alias("totalPages"),
    )


def first_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first n rows by ``order_by`` (a sample of the primary table)."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def top_by_magnitude(df: DataFrame, value: str, k: int, ties: Sequence[str]) -> DataFrame:
    """k rows of largest \\|value\\|, ties by the given columns."""
    return df.orderBy(F.abs(col(value)).desc(), *[col(c) for c in ties]).limit(k)


def common_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct present keys found on both sides."""
    a = left.select(col(left_key).alias("key")).filter("key IS NOT NULL")
    return a.intersect(right.select(col(right_key).alias("key")))


def keys_only_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct present keys of the left side that the right side lacks."""
    a = left.select(col(left_key).alias("key")).filter("key IS NOT NULL").distinct()
    b = right.select(col(right_key).alias("key")).filter("key IS NOT NULL").distinct()
    return a.join(b, "key", "left_anti")


def union_history(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; a column one part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out

"""Build one wide feature table from a collection, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import name_frame
from ..plans.collection import Collection, orphaned_aggregations, validate_collection
from .aggregate import aggregate_table, drop_duplicate_rows
from .joins import explosion_check, first_row_per_key, join_tables
from .projection import first_rows, handle_missing as handle_missing_rows


@dataclass
class Derived:
    """The wide table, still lazy, and what is known without running it."""

    df: DataFrame
    primary: DataFrame
    tables_joined: list[str] = field(default_factory=list)
    columns_added: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    guarded: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


def build_wide_table(collection: Collection, tables: Mapping[str, DataFrame], *,
                     sample_rows: int | None = None, drop_duplicates: bool = False,
                     handle_missing: str = "keep", guard: bool = True) -> Derived:
    """Aggregate the detail tables, fold the joins, post-process.

    Relationships are folded in order onto the growing table, so the left
    column is looked up in what has been joined so far.  An aggregated table
    has unique keys; a raw one is cut to the first row per key unless
    ``guard`` is off (then its rows multiply, as in a plain join).  Unknown
    tables, double entries and self joins are errors; an absent column or an
    unknown function is skipped and told in ``warnings``.  Nothing runs until
    the caller acts on ``df``.
    """
    problems = validate_collection(collection, tables, columns=False)
    if problems:
        raise ValueError("; ".join(problems))
    primary = tables[collection.primary]
    if sample_rows:
        order = collection.order_by.get(collection.primary)
        primary = first_rows(primary, order, sample_rows) if order else primary.limit(sample_rows)
    out = Derived(df=primary, primary=primary)

    if collection.target and collection.target not in primary.columns:
        out.warnings.append(f"target column '{collection.target}' not in table '{collection.primary}'")
    rolled: dict[str, DataFrame] = {}
    for a in collection.aggregations:
        try:
            rolled[a.table], notes = aggregate_table(
                tables[a.table], a.group_by, a.prefix, a.features,
                a.order_by or collection.order_by.get(a.table))
            out.warnings += [f"'{a.table}': {n}" for n in notes]
        except ValueError as error:
            out.warnings.append(f"aggregation failed for '{a.table}': {error}")
    for table in orphaned_aggregations(collection):
        out.warnings.append(f"'{table}' is aggregated but no relationship joins it")

    merged = primary
    for r in collection.relationships:
        aggregated = r.right_table in rolled
        right = rolled[r.right_table] if aggregated else tables[r.right_table]
        if r.left_column not in merged.columns or r.right_column not in right.columns:
            out.warnings.append(f"join skipped for '{r.right_table}': key column not found")
            continue
        if guard and not aggregated:
            out.guarded[r.right_table] = (right, r.right_column)
            right = first_row_per_key(right, r.right_column, collection.order_by.get(r.right_table))
        # An aggregated side has no null key, so plain equality gives the same rows.
        merged = join_tables(
            merged, right, r.left_column, r.right_column, r.join_type, r.right_table,
            null_safe=not aggregated, coerce=guard,
        ).df
        out.tables_joined.append(r.right_table)

    if drop_duplicates:
        merged = drop_duplicate_rows(merged)
    out.df = handle_missing_rows(merged, handle_missing)
    have = set(primary.columns)
    out.columns_added = [c for c in out.df.columns if c not in have]
    return out


def build_report(derived: Derived) -> DataFrame:
    """One row on a build: rows and columns before and after, tables joined."""
    before = derived.primary.agg(F.count(F.lit(1)).alias("rows_before"))
    after = derived.df.agg(F.count(F.lit(1)).alias("rows_after"))
    return after.select(
        before.scalar().alias("rows_before"), "rows_after",
        F.lit(len(derived.primary.columns)).alias("columns_before"),
        F.lit(len(derived.df.columns)).alias("columns_after"),
        F.lit(len(derived.columns_added)).alias("columns_added"),
        F.lit(len(derived.tables_joined)).alias("tables_joined"),
    )


def guard_report(derived: Derived) -> DataFrame | None:
    """One row per raw joined table: whether the guard had rows to drop."""
    parts = [
        explosion_check(df, key).select(F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "*")
        for name, (df, key) in derived.guarded.items()
    ]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def warning_rows(derived: Derived) -> DataFrame:
    """Warnings known from the configuration, as rows."""
    spark = derived.df.sparkSession
    if not derived.warnings:
        return name_frame(spark, [{"warning": ""}]).filter("false")
    return name_frame(spark, [{"warning": w} for w in derived.warnings])

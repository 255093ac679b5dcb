"""Grouped aggregation of detail tables, value counts and duplicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..plans.schema import identity_of, is_numeric, key_cells, with_row_order
from .ranking import group_quantiles


@dataclass(frozen=True)
class AggFunction:
    """One entry of the registry.

    ``build`` takes the column and the order column (None without one).
    ``apart`` names a function that cannot be an ordinary aggregate without
    holding a whole group in one buffer; it gets a frame of its own.  Of
    ``distinct`` ones several columns are counted together (``distinct_counts``).
    """

    suffix: str
    build: Callable[[Column, Column | None], Column] | None = None
    numeric_only: bool = False
    needs_order: bool = False
    apart: str | None = None
    distinct: bool = False


AGG_FUNCTIONS: dict[str, AggFunction] = {
    # An all-null group sums to 0.
    "sum": AggFunction("sum", lambda c, _: F.coalesce(F.sum(c), F.lit(0)), numeric_only=True),
    "mean": AggFunction("mean", lambda c, _: F.avg(c), numeric_only=True),
    "median": AggFunction("median", numeric_only=True, apart="median"),
    "approx_median": AggFunction("approx_median", lambda c, _: F.percentile_approx(c, 0.5), numeric_only=True),
    "max": AggFunction("max", lambda c, _: F.max(c)),
    "min": AggFunction("min", lambda c, _: F.min(c)),
    "count": AggFunction("count", lambda c, _: F.count(c)),
    "unique_count": AggFunction("unique_count", lambda c, _: F.count_distinct(c), distinct=True),
    "nunique": AggFunction("unique_count", lambda c, _: F.count_distinct(c), distinct=True),
    "approx_unique_count": AggFunction("approx_unique_count", lambda c, _: F.approx_count_distinct(c)),
    "std": AggFunction("std", lambda c, _: F.stddev_samp(c), numeric_only=True),
    "variance": AggFunction("variance", lambda c, _: F.var_samp(c), numeric_only=True),
    "var": AggFunction("variance", lambda c, _: F.var_samp(c), numeric_only=True),
    # First and last value that is present, in row order.
    "first": AggFunction("first", lambda c, o: F.min_by(c, F.when(c.isNotNull(), o)), needs_order=True),
    "last": AggFunction("last", lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)), needs_order=True),
    "mode": AggFunction("mode", apart="mode"),
}


def register_agg_function(name: str, build: Callable[[Column, Column | None], Column], *,
                          suffix: str | None = None, numeric_only: bool = False,
                          needs_order: bool = False) -> None:
    """Add an aggregation of your own, as a column expression."""
    AGG_FUNCTIONS[name] = AggFunction(suffix or name, build, numeric_only, needs_order)


def created_columns(prefix: str, features: Sequence[dict]) -> list[str]:
    """Names an aggregation will create; only the function part is ever renamed."""
    return [
        f"{prefix}{f['column']}_{AGG_FUNCTIONS[fn].suffix}"
        for f in features for fn in f["functions"] if fn in AGG_FUNCTIONS
    ]


def _order_column(df: DataFrame, order_by: Sequence[str] | None) -> Column:
    if order_by:
        return F.struct(*[col(c) for c in order_by]) if len(order_by) > 1 else col(order_by[0])
    return F.col("_row_order")


def aggregate_table(df: DataFrame, group_by: str, prefix: str, features: Sequence[dict],
                    order_by: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Roll a detail table up to one row per key.

    ``features`` is ``[{"column": ..., "functions": [...]}, ...]``.  Returns the
    frame (key plus ``{prefix}{column}_{function}``) and the notes on what was
    skipped: unknown columns or functions, and numeric functions on text.
    Null keys form no group.  ``first``/``last`` follow ``order_by``; without it
    they follow the order of the files (``with_row_order``).

    Everything that has a fixed-size buffer is one hash aggregate with map-side
    partials.  Distinct counts of several columns are taken together from narrow
    cells, so the other aggregates' rows are not multiplied.  Medians and modes are reduced to (key, value, count) first, so a
    hot key never fills one task's memory.
    """
    if group_by not in df.columns:
        raise ValueError(f"group-by column '{group_by}' not found; available: {df.columns[:10]}")
    types = {f.name: f.dataType for f in df.schema.fields}
    notes: list[str] = []
    plain: list[tuple[str, AggFunction, str]] = []
    apart: dict[str, list[tuple[str, str]]] = {"median": [], "mode": []}
    names: list[str] = []
    for feature in features:
        column = feature["column"]
        if column not in types:
            notes.append(f"column '{column}' not found, skipped")
            continue
        for fn in feature["functions"]:
            spec = AGG_FUNCTIONS.get(fn)
            if spec is None:
                notes.append(f"unknown function '{fn}', skipped")
                continue
            if spec.numeric_only and not is_numeric(types[column]):
                notes.append(f"'{fn}' needs numbers, skipped for text column '{column}'")
                continue
            name = f"{prefix}{column}_{spec.suffix}"
            if name in names:
                continue
            names.append(name)
            if spec.apart:
                apart[spec.apart].append((column, name))
            else:
                plain.append((column, spec, name))
    if not names:
        raise ValueError("no valid aggregation features")

    if any(spec.needs_order for _, spec, _ in plain) and not order_by:
        df = with_row_order(df)
    counted = [(c, name) for c, spec, name in plain if spec.distinct]
    if len({c for c, _ in counted}) > 1:
        plain = [p for p in plain if not p[1].distinct]
    else:
        counted = []
    order = _order_column(df, order_by)
    rows = df.filter(col(group_by).isNotNull())
    key = col(group_by)
    out = rows.groupBy(key).agg(
        *[spec.build(col(c), order if spec.needs_order else None).alias(name) for c, spec, name in plain]
    ) if plain else rows.select(key).distinct()

    parts = [distinct_counts(rows, [group_by], {name: c for c, name in counted})] if counted else []
    for c, name in apart["median"]:
        parts.append(group_quantiles(rows.select(key, col(c)), [group_by], c, {name: 0.5})
                     if c != group_by else rows.groupBy(key).agg(F.max(key).cast("double").alias(name)))
    for c, name in apart["mode"]:
        parts.append(group_mode(rows, group_by, c, name))
    for part in parts:
        extra = part.withColumnRenamed(group_by, "_k")
        # The value of one side is one row per key, so this join never multiplies rows.
        out = out.join(extra, col(group_by) == F.col("_k"), "left").drop("_k")
    none = {name for _, name in counted}  # a key without any present value
    return out.select(key, *[F.coalesce(col(n), F.lit(0)).alias(n) if n in none else col(n) for n in names]), notes


def distinct_counts(df: DataFrame, groups: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Distinct present values of several columns per group: the group, and one count for each name in ``columns``.

    Cells become (group, column, key of the value), each task keeps one of equal
    ones, and what is left is counted.  A hot group is spread over all tasks by its
    values, and no row of the table is repeated with all it holds.  A group without
    any present value has no row.
    """
    different = list(dict.fromkeys(columns.values()))
    cells = key_cells(df, different, list(groups)).filter("_a IS NOT NULL")
    keys = [col(g) for g in groups]
    return cells.distinct().groupBy(*keys).agg(*[F.count_if(F.col("_i") == different.index(c)).alias(name) for name, c in columns.items()])


def group_mode(df: DataFrame, group_by: str, column: str, name: str) -> DataFrame:
    """Most frequent present value per key, the smallest one on ties."""
    counted = (
        df.filter(col(column).isNotNull()).groupBy(col(group_by), col(column).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = counted.groupBy(col(group_by)).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v"))).alias("_best"))
    return best.select(col(group_by), F.col("_best._v").alias(name))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, duplicates (null equals null).

    Long texts take part by their SHA-256, so the shuffle stays narrow.
    """
    groups = df.groupBy(*[identity_of(f).alias(f.name) for f in df.schema.fields]).agg(
        F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("duplicates", F.col("total_rows") - F.col("distinct_rows"))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def counts_by_two_keys(df: DataFrame, first: str, second: str, time: str) -> DataFrame:
    """Counts by each of two keys and in total, with the latest time, in one pass.

    ``section`` is ``total`` or the key's name.
    """
    return (
        df.groupingSets([[first], [second], []], first, second)
        .agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), F.max(time).alias("last_at"))
        .select(
            F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, first).otherwise(second).alias("section"),
            F.when(F.col("_g") == 1, col(first)).when(F.col("_g") == 2, col(second)).alias("value"),
            "total", "last_at",
        )
    )


def count_statuses(df: DataFrame, status: str, wanted: Sequence[str],
                   flags: Sequence[str] = ()) -> DataFrame:
    """Total, one count per wanted status and one per boolean flag, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(col(f)).alias(f) for f in flags],
        *[F.count_if(col(status) == s).alias(s) for s in wanted],
    )

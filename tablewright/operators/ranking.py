"""Running totals, positions and exact quantiles that no hot group can stall.

A plain ``Window.partitionBy(key).orderBy(v)`` sends a whole key to one task,
and a window without keys sends everything there.  Here the ordered domain is
cut at ~1000 split points drawn from the data by hash, totals are taken per
(group, bucket), and only those small totals are cumulated per group; rows are
then windowed inside (group, bucket).  A bucket holds about a thousandth of the
rows whatever the key distribution, so a key with a third of the table is
spread over some 330 tasks.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, quoted
from ..plans.schema import numeric_cells, numeric_columns

_FAN = 10  # split points are searched in three steps of this width


def _split_points(df: DataFrame, by: Column, spread: Column) -> Column:
    """Scalar subquery: up to 999 sorted values of ``by``, those of the smallest hashes.

    The struct holds three lists of steps: hundreds, tens and single points.
    """
    last = _FAN ** 3 - 1
    sample = (
        df.select(by.alias("v"), F.xxhash64(spread).alias("h")).orderBy("h", "v").limit(last)
        .agg(F.array_sort(F.collect_list("v")).alias("a"))
    )

    def every(step: int, of: str) -> str:
        return f"transform(sequence(1, {_FAN - 1}), i -> get(a, {of} + i * {step} - 1))"

    return sample.select(F.struct(
        F.expr(every(_FAN ** 2, "0")).alias("hundreds"),
        F.expr(f"transform(sequence(0, {_FAN - 1}), h -> {every(_FAN, f'h * {_FAN ** 2}')})").alias("tens"),
        F.expr(f"transform(sequence(0, {_FAN ** 2 - 1}), t -> {every(1, f't * {_FAN}')})").alias("ones"),
    )).scalar()


def _with_bucket(df: DataFrame, order_by: Sequence[str], groups: Sequence[str], used: Sequence[str]) -> DataFrame:
    """Add ``_bucket``: how many split points are at or below the row's order value.

    Rows are drawn by a hash of everything ``running`` uses, which also keeps
    the sample's plan equal to the other branches', so that the shuffle that
    made ``df`` is reused and not run again.
    """
    names = [quoted(c) for c in order_by]
    by = names[0] if len(names) == 1 else f"struct({', '.join(names)})"
    spread = F.struct(*[col(c) for c in [*order_by, *groups, *used]])
    # Any text splits the order, so a short beginning of a drawn one does: 999 whole documents need not be kept.
    short = [f"substring({n}, 1, 64) AS {n}" if isinstance(df.schema[c].dataType, T.StringType) else n for c, n in zip(order_by, names)]
    point = f"struct({', '.join(short)})" if len(short) > 1 else short[0].removesuffix(f" AS {names[0]}")

    def reached(points: str) -> str:
        # Written out, not as a lambda, so that it is compiled; a missing point compares as null.
        return " + ".join(f"CASE WHEN get({points}, {i}) <= {by} THEN 1 ELSE 0 END" for i in range(_FAN - 1))

    # ``_bucket`` can never be null, or the optimizer would test it for null far below, on raw rows.
    out = df.withColumn("_splits", _split_points(df, F.expr(point), spread))
    out = out.selectExpr("*", f"{reached('_splits.hundreds')} AS _hundreds")
    out = out.selectExpr("*", "get(_splits.tens, _hundreds) AS _points")
    out = out.selectExpr("*", f"_hundreds * {_FAN} + {reached('_points')} AS _tens")
    out = out.selectExpr("*", "get(_splits.ones, _tens) AS _last")
    out = out.selectExpr("*", f"_tens * {_FAN} + {reached('_last')} AS _bucket")
    return out.drop(*_RESERVED[1:])


# Columns that exist only inside this module.
_RESERVED = ["_bucket", "_splits", "_hundreds", "_points", "_tens", "_last"]


def running(df: DataFrame, groups: list[str], order_by: list[str],
            sums: Mapping[str, Column] | None = None,
            maxima: Mapping[str, Column] | None = None,
            totals_of: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` plus running sums and maxima, in ascending ``order_by`` within ``groups``.

    ``order_by`` has to be unique within a group.  Order descending by a
    negated column.  Sums include the current row.  ``totals_of`` adds the
    group's total of a sum under a new name; it comes with the bucket totals
    and costs nothing more.
    """
    sums, maxima, totals_of = dict(sums or {}), dict(maxima or {}), dict(totals_of or {})
    clash = set(_RESERVED) & set(df.columns)
    if clash:
        raise ValueError(f"reserved column names in use: {sorted(clash)}")
    order = [col(c) for c in order_by]
    rows = df.select("*", *[value.alias(f"_in_{name}") for name, value in {**sums, **maxima}.items()])
    rows = _with_bucket(rows, order_by, groups, [f"_in_{n}" for n in [*sums, *maxima]])

    totals = rows.groupBy(*[col(g) for g in groups], "_bucket").agg(
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_tot_{n}") for n in maxima],
    )
    # At most ~1000 totals per group, so this window is small for any key.
    earlier = (
        Window.partitionBy(*[col(g) for g in groups]).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*[col(g) for g in groups])
    before = totals.select(
        *[F.sum(f"_tot_{n}").over(whole).alias(f"_all_{out}") for out, n in totals_of.items()],
        *[col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_tot_{n}").over(earlier), F.lit(0)).alias(f"_pre_{n}") for n in sums],
        *[F.max(f"_tot_{n}").over(earlier).alias(f"_pre_{n}") for n in maxima],
    )
    match = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        match = match & col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = (
        Window.partitionBy(*[col(g) for g in groups], "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = rows.join(before, match, "inner")
    return joined.select(
        *[col(c) for c in df.columns],
        *[(F.sum(f"_in_{n}").over(inside) + F.col(f"_pre_{n}")).alias(n) for n in sums],
        *[F.greatest(F.max(f"_in_{n}").over(inside), F.col(f"_pre_{n}")).alias(n) for n in maxima],
        *[F.col(f"_all_{out}").alias(out) for out in totals_of],
    )


def dense_index(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Distinct present values of a column with their 0-based sorted position."""
    values = df.select(col(column)).filter(col(column).isNotNull()).distinct()
    ranked = running(values, [], [column], sums={name: F.lit(1).cast("bigint")})
    return ranked.withColumn(name, F.col(name) - 1)


def group_quantiles(df: DataFrame, groups: list[str], value: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; any number of groups.

    Rows are first reduced to (group, value, count), then ranked with
    ``running``; a group's values are never gathered in one task.
    """
    counted = (
        df.filter(col(value).isNotNull())
        .groupBy(*[col(g) for g in groups], col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running(counted, groups, ["_v"], sums={"_upto": F.col("_n")}, totals_of={"_size": "_upto"})
    return _pick(placed, [col(g).alias(g) for g in groups], probs)


def _pick(placed: DataFrame, keys: list[Column], probs: Mapping[str, float]) -> DataFrame:
    """Interpolate from rows (keys, _v, _n, _upto, _size): one algebraic aggregate."""
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.floor(at), F.ceil(at)
        before = F.col("_upto") - F.col("_n")

        def value_at(rank: Column) -> Column:
            return F.max(F.when((before <= rank) & (rank < F.col("_upto")), F.col("_v")))

        weight = F.max(at - low)
        a, b = value_at(low), value_at(high)
        out.append((a + (b - a) * weight).alias(name))
    return placed.groupBy(*keys).agg(*out)


_SKETCH_SIZE = 4096  # of a KLL sketch: its rank error has a standard deviation of about 0.03 %
_MARGIN = 0.004  # 14 of them
_PARTS = 256  # sketches of a column that one task merges, at most


def column_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n present values and a KLL sketch of their order, from one scan of these columns.

    A task keeps one sketch per column; those of a 256th of the tasks are merged
    first, so no task merges them all.  Other aggregates stay out of it: beside a
    sketch they would not be compiled.
    """
    parts = df.groupBy((F.spark_partition_id() % _PARTS).alias("_part")).agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(col(c)).alias("_n"), F.kll_sketch_agg_double(col(c).cast("double"), _SKETCH_SIZE).alias("_sketch"),
        ).alias(f"_{i}") for i, c in enumerate(columns)
    ]).select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
    return parts.groupBy("column").agg(F.sum("_n").alias("n"), F.kll_merge_agg_double("_sketch").alias("sketch"))


def column_quantiles(df: DataFrame, probs: Mapping[str, float], columns: Sequence[str] | None = None,
                     approx: bool = False) -> DataFrame:
    """Exact quantiles per numeric column: column and one value per name in ``probs``.

    Two passes and no shuffle of the data: sketches bracket every quantile by two
    values, as tightly for sorted rows as for mixed ones, then one aggregate keeps
    distinct values only inside the brackets (under one percent of the rows each)
    and of every gap between them just the count and the two bordering values.
    Should a wanted rank still lie inside a gap, which takes an error of 14 standard
    deviations, the query fails rather than answer wrongly.  ``approx`` stops after
    the sketch: one pass, not interpolated.
    """
    names = list(probs)
    numeric = list(columns) if columns is not None else numeric_columns(df)
    if not numeric:
        fields = ", ".join(f"{quoted(n)} double" for n in names)
        return df.sparkSession.createDataFrame([], f"column string, {fields}")
    sketches = column_sketches(df, numeric).filter("n > 0")

    def at(p: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(p, 0.0), 1.0)))

    if approx:
        return sketches.select("column", *[at(probs[n]).alias(n) for n in names])
    bounds = sketches.select(
        F.col("column").alias("_column"), F.col("n").alias("_size"),
        *[at(probs[n] - _MARGIN).alias(f"_lo{i}") for i, n in enumerate(names)],
        *[at(probs[n] + _MARGIN).alias(f"_hi{i}") for i, n in enumerate(names)])
    # One row per column: bounded by the schema, so broadcast.
    near = numeric_cells(df, numeric).join(F.broadcast(bounds), F.col("column") == F.col("_column"))
    value, inside, gap = F.col("value"), F.lit(False), F.lit(0)
    for i in range(len(names)):
        inside = inside | ((value >= F.col(f"_lo{i}")) & (value <= F.col(f"_hi{i}")))
        gap = gap + F.when(value > F.col(f"_hi{i}"), 1).otherwise(0)
    counted = near.groupBy(
        "column", "_size", F.when(inside, value).alias("_v"), F.when(~inside, gap).alias("_gap"),
    ).agg(F.min("value").alias("_least"), F.max("value").alias("_most"), F.count(F.lit(1)).alias("_n"))
    # (In this order ``running`` asks for them, so all its branches share one shuffle.)
    ranked = running(counted, ["column"], ["_least", "_most"], sums={"_upto": F.col("_n")})
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.floor(at), F.ceil(at)
        before = F.col("_upto") - F.col("_n")

        def value_at(rank: Column) -> Column:
            found = F.when((F.col("_least") == F.col("_most")) | (rank == before), F.col("_least")).when(
                rank == F.col("_upto") - 1, F.col("_most"))
            hit = F.max(F.when((before <= rank) & (rank < F.col("_upto")), found))
            return F.when(hit.isNotNull(), hit).otherwise(
                F.raise_error(F.lit("quantile fell outside its bracket")).cast("double"))

        a, b = value_at(low), value_at(high)
        out.append((a + (b - a) * F.max(at - low)).alias(name))
    return ranked.groupBy("column").agg(*out)

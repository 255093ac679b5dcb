"""Guarded equi-joins of one table onto another.

Right and full joins are put together from a left or inner join and an anti
join: adaptive execution can split a hot key in those, but not in a right or
full outer join whose hot key is on the left.
"""

from __future__ import annotations

from collections.abc import Sequence
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..plans.schema import is_float, is_integer, is_numeric, overlap, with_row_order

JOIN_TYPES = ("left", "inner", "right", "full")


def first_row_per_key(df: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of every key (the null key counts as one key).

    The ``row_number = 1`` filter becomes a group limit that runs before the
    shuffle, so each task sends at most one row per key, hot or not.  Without
    ``order_by`` the order is that of the files (``with_row_order``).
    """
    if not order_by:
        df = with_row_order(df)
        order = [F.col("_row_order")]
    else:
        order = [col(c) for c in order_by]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(col(key)).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank", "_row_order")


def explosion_check(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct present keys, average rows per key, whether a raw join multiplies rows."""
    per_key = df.groupBy(col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count("_k").alias("unique_keys"),
    ).select(
        "total_rows", "unique_keys",
        (F.col("total_rows") / F.greatest("unique_keys", F.lit(1))).alias("rows_per_key"),
        (F.col("unique_keys") < F.col("total_rows")).alias("explodes"),
    )


def key_text(value: Column, dtype) -> Column:
    """A key as text; whole doubles without the ``.0``, so 1.0 meets "1"."""
    if is_float(dtype):
        whole = value.try_cast("bigint")
        return F.when(whole.cast("double") == value.cast("double"), whole.cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def coerce_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Bring two key columns to one type.

    Integer against decimal: both one decimal that holds either, so the
    comparison is exact.  Integer against float: both double, which tells
    integers apart up to 2**53 only.  Number against text: both text.  Same
    family: unchanged.
    """
    lt, rt = left.schema[left_key].dataType, right.schema[right_key].dataType
    if lt == rt:
        return left, right
    if isinstance(lt, T.DecimalType) and is_integer(rt) or is_integer(lt) and isinstance(rt, T.DecimalType):
        one = lt if isinstance(lt, T.DecimalType) else rt
        whole = T.DecimalType(min(38, max(19, one.precision - one.scale) + one.scale), one.scale)
        return left.withColumn(left_key, col(left_key).cast(whole)), right.withColumn(right_key, col(right_key).cast(whole))
    if is_integer(lt) and is_float(rt):
        return left.withColumn(left_key, col(left_key).cast("double")), right
    if is_float(lt) and is_integer(rt):
        return left, right.withColumn(right_key, col(right_key).cast("double"))
    if is_numeric(lt) != is_numeric(rt):
        return (left.withColumn(left_key, key_text(col(left_key), lt)),
                right.withColumn(right_key, key_text(col(right_key), rt)))
    return left, right


@dataclass(frozen=True)
class Joined:
    df: DataFrame
    renamed: dict[str, str]


def join_tables(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                how: str = "left", right_name: str = "right", null_safe: bool = True,
                coerce: bool = True) -> Joined:
    """Join ``right`` onto ``left`` on one key pair.

    Null keys meet null keys unless ``null_safe`` is off.  Columns of the right
    side whose name is taken become ``{right_name}_{column}``, with a number
    after it where that is taken too.  The output has
    the key once, under the left name; rows that exist only on the right keep
    their key.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}")
    if coerce:
        left, right = coerce_keys(left, right, left_key, right_key)
    taken = [c for c in overlap(left.columns, right.columns) if c != right_key]
    used, renamed = set(left.columns) | set(right.columns), {}
    for c in taken:
        names = itertools.chain([f"{right_name}_{c}"], (f"{right_name}_{c}_{i}" for i in itertools.count(2)))
        renamed[c] = next(n for n in names if n not in used)
        used.add(renamed[c])
    others = [c for c in right.columns if c != right_key]
    side = right.select(col(right_key).alias("_right_key"), *[col(c).alias(renamed.get(c, c)) for c in others])
    right_out = [renamed.get(c, c) for c in others]
    a, b = col(left_key), F.col("_right_key")
    match = a.eqNullSafe(b) if null_safe else (a == b)

    kept = left.join(side, match, "left" if how in ("left", "full") else "inner")
    out = kept.select(*[col(c) for c in left.columns], *[col(c) for c in right_out])
    if how in ("right", "full"):
        keys = left.select(a.alias("_left_key")).distinct()
        lk = F.col("_left_key")
        only_right = side.join(keys, lk.eqNullSafe(b) if null_safe else (lk == b), "left_anti")
        fill = [
            (b.cast(f.dataType) if f.name == left_key else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in left.schema.fields
        ]
        out = out.union(only_right.select(*fill, *[col(c) for c in right_out]))
    return Joined(out, renamed)


def join_lookup(df: DataFrame, lookup: DataFrame, match: Column) -> DataFrame:
    """Left join onto a table that is expected, but not known, to be small.

    Nothing is counted or held: adaptive execution broadcasts the lookup when
    its bytes allow it, and splits hot keys when they don't.
    """
    return df.join(lookup, match, "left")


def orphan_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose key the right side lacks (null keys are orphans)."""
    keys = right.select(col(right_key).alias("_k")).filter("_k IS NOT NULL").distinct()
    return left.join(keys, col(left_key) == F.col("_k"), "left_anti")


def matched_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose key the right side has."""
    keys = right.select(col(right_key).alias("_k")).filter("_k IS NOT NULL").distinct()
    return left.join(keys, col(left_key) == F.col("_k"), "left_semi")

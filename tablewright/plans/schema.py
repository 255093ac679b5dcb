"""What a schema alone tells: column kinds, display types, name overlaps."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, quoted

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGERS)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATS)


def is_numeric(dtype: T.DataType) -> bool:
    return is_integer(dtype) or is_float(dtype)


def kind_of(dtype: T.DataType) -> str:
    """numeric, categorical, datetime or other (booleans are other)."""
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def display_type(dtype: T.DataType) -> str:
    if is_integer(dtype):
        return "INTEGER"
    if is_float(dtype):
        return "FLOAT"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    if isinstance(dtype, T.DateType):
        return "DATE"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "TIMEDELTA"
    return "VARCHAR"


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        out[kind_of(f.dataType)].append(f.name)
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_by_kind(df)["numeric"]


def overlap(left: list[str], right: list[str]) -> list[str]:
    """Names on both sides, in the right side's order."""
    have = set(left)
    return [c for c in right if c in have]


def flatten_struct(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs to one level; names are the path joined by ``separator``."""
    out = []

    def walk(dtype: T.DataType, path: list[str]) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, path + [f.name])
        else:
            value = col(path[0])
            for part in path[1:]:
                value = value.getField(part)
            out.append(value.alias(separator.join(path)))

    for f in df.schema.fields:
        walk(f.dataType, [f.name])
    return df.select(*out)


def text_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every cell as (column, value): the value as text, null kept.

    Text over 64 characters is replaced by its SHA-256, which keeps equal
    values equal and different ones different while the shuffle moves 64 bytes
    and not the whole text.
    """
    names = columns if columns is not None else df.columns
    wide = df.select(*[identity_of(df.schema[n]).cast("string").alias(n) for n in names])
    return wide.unpivot([], [quoted(n) for n in names], "column", "value")


def identity_of(field: T.StructField) -> Column:
    """A short value that is equal exactly when the column's values are."""
    value = col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return value + F.lit(0.0)  # one zero, not two
    if isinstance(field.dataType, T.StringType):
        return F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.sha2(F.to_json(F.struct(value), {"ignoreNullFields": "false"}), 256)
    return value


def with_row_order(df: DataFrame, name: str = "_row_order") -> DataFrame:
    """Add a column that sorts rows as their files hold them.

    Parquet tells a row's file and its number there, which no repartitioning,
    filter or projection since the scan changes.  Other files tell the block a row was
    read from; inside a block, and where there is no file at all, the place in the
    task counts, so there the order holds until rows are shuffled.
    """
    place = F.monotonically_increasing_id()
    for parts in (["_metadata.file_path", "_metadata.row_index"], ["_metadata.file_path", "_metadata.file_block_start", place]):
        try:
            return df.withColumn(name, F.struct(*parts))
        except AnalysisException:
            continue
    return df.withColumn(name, place)


# Types of at most 8 bytes: a 64-bit hash of one such value is a permutation, so it tells them apart exactly.
_NARROW = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def cell_key(field: T.StructField) -> list[Column]:
    """Two integers that tell a column's values apart, null for null: exact for narrow types, 128 bits of hash for others.

    No number is turned into text for it, and a long text moves 16 bytes.
    """
    kind = field.dataType
    value = identity_of(field) if not isinstance(kind, T.StringType) else col(field.name)
    exact = isinstance(kind, _NARROW) or isinstance(kind, T.DecimalType) and kind.precision <= 18
    there = col(field.name).isNotNull()
    second = F.lit(0).cast("bigint") if exact else F.xxhash64(F.lit("second"), value)
    return [F.when(there, F.xxhash64(value)), F.when(there, second)]


def key_cells(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Every cell as (columns to keep, _i, _a, _b): the column's place in ``names`` and its value's key."""
    cells = [F.struct(F.lit(i).alias("_i"), *(k.alias(n) for k, n in zip(cell_key(df.schema[c]), ("_a", "_b")))) for i, c in enumerate(names)]
    return df.select(*[col(c) for c in keep or []], F.inline(F.array(*cells)))


def numeric_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every present numeric cell as (column, value double)."""
    names = columns if columns is not None else numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value double")
    wide = df.select(*[col(n).cast("double").alias(n) for n in names])
    return wide.unpivot([], [quoted(n) for n in names], "column", "value").filter("value IS NOT NULL")


# Short names of well-known tables.
_TABLE_SHORT = {
    "bureau": "BUREAU",
    "previous_application": "PREV_APP",
    "credit_card_balance": "CC_BAL",
    "pos_cash_balance": "POS_CASH",
    "installments_payments": "INST_PAY",
    "application_train": "APP",
    "application_test": "APP_TEST",
}


def table_prefix(table: str) -> str:
    """Upper-case prefix of a table's features: its short name, or 8 letters of one word, or 4 of each of three."""
    words = re.split("[_ \t\r\n]+", table)
    letters = 8 if len(words) == 1 else 4
    return _TABLE_SHORT.get(table.lower(), "_".join(w[:letters] for w in words[:3]).upper()) + "_"

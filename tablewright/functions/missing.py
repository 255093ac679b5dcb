"""Missing values: one meaning (null) for null, NaN, infinity and NA text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col

# The texts pandas' CSV reader takes for a missing value.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite_or_null(value: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def _finite_deep(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite_or_null(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _finite_deep(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: _finite_deep(item, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [_finite_deep(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def finite_or_null_deep(df: DataFrame) -> DataFrame:
    """``finite_or_null`` on every float, also inside arrays, maps and structs."""
    return df.select(*[_finite_deep(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def normalize_missing(df: DataFrame, na_texts: list[str] | None = None) -> DataFrame:
    """Float NaN becomes null; so does any string that is one of ``na_texts``.

    Spark keeps NaN apart from null (``max`` returns it, ``count`` counts it),
    so this runs once where data enters.
    """
    out = []
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            value = nan_to_null(value)
        elif isinstance(f.dataType, T.StringType) and na_texts:
            value = F.when(~value.isin(na_texts), value)
        out.append(value.alias(f.name))
    return df.select(*out)

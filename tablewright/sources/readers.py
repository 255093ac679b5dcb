"""Sources: CSV, parquet, JSON, JDBC, report files, logs and whole collections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.missing import NA_TEXTS, normalize_missing


def read_source(spark: SparkSession, kind: str, path: str | None = None,
                schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Any Spark format (parquet, json, csv, jdbc, ...), with missing values normalised."""
    if kind == "csv":
        return read_csv(spark, path, schema=schema, **options)
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return normalize_missing(reader.load(path) if path else reader.load())


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = False, **options) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks.  NA texts become null before any cast.

    ``options`` are the reader's and override the defaults.  A file whose
    fields may hold line breaks is read by one task; ``multiLine=False`` makes
    large files splittable, for data known to have none.  Columns are matched
    with ``schema`` by the header's names; one that the file lacks is an error.

    The file is read as text and cast afterwards, because Spark's own CSV
    reader knows one null text only.  ``schema`` casts without another pass
    (text that does not fit becomes null); ``infer=True`` costs one pass that
    tests every column over the whole file.  Without either, columns stay text.
    """
    reader = spark.read.options(**{"header": True, "multiLine": True, "escape": '"', **options})
    if schema is None:
        text = normalize_missing(reader.csv(path), NA_TEXTS)
        return cast_text(text, infer_types(text)) if infer else text
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text = reader.csv(path)
    if str(options.get("header", True)).lower() == "true":
        if missing := [f.name for f in schema.fields if f.name not in text.columns]:
            raise ValueError(f"columns not in the file: {missing}")
        text = text.select(*[col(f.name) for f in schema.fields])
    else:
        text = text.toDF(*schema.fieldNames())
    text = normalize_missing(text, NA_TEXTS)
    return cast_text(text, {f.name: f.dataType for f in schema.fields})


def cast_text(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    return df.select(*[col(n).try_cast(types.get(n, T.StringType())).alias(n) for n in df.columns])


def infer_types(text: DataFrame) -> dict[str, T.DataType]:
    """Narrowest of bigint, double, boolean, string that fits every value.

    One aggregate over the whole input; only three flags per column come back.
    """
    if not text.columns:
        return {}
    tests = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    aggs = []
    for i, name in enumerate(text.columns):
        value = col(name)
        whole = value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("bigint").isNotNull()
        flag = F.lower(value).isin("true", "false")
        fits = {"bigint": whole, "double": value.try_cast("double").isNotNull(), "boolean": flag}
        seen = F.count(value) > 0
        aggs += [(seen & F.every(value.isNull() | fits[t])).alias(f"{i}_{t}") for t in tests]
    row = text.agg(*aggs).first()
    out = {}
    for i, name in enumerate(text.columns):
        hit = next((t for t in tests if row[f"{i}_{t}"]), None)
        out[name] = tests[hit] if hit else T.StringType()
    return out


def read_key_column(spark: SparkSession, path: str, key: str, kind: str = "parquet") -> DataFrame:
    """One column of a table; the scan reads nothing else."""
    return read_source(spark, kind, path).select(col(key))


def read_report(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV report whose number columns may hold bad text (null then)."""
    text = read_csv(spark, path)
    return text.select(*[
        (col(n).try_cast("double") if n in numbers else col(n)).alias(n) for n in text.columns
    ])


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON summary file (one document, possibly over many lines)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files as (file, position, line), blank lines dropped.

    ``position`` orders lines inside a file: first the block the line was read
    from, then its place in that block.  It is not a line number.
    """
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("place"),
            ).alias("position"),
            F.trim("value").alias("line"),
        )
        .filter("line <> ''")
    )


def preview(df: DataFrame, order_by: list[str], rows: int = 20) -> DataFrame:
    """First rows by ``order_by``; 1 to 500 of them, non-finite numbers as null."""
    if not 1 <= rows <= 500:
        raise ValueError("rows must be between 1 and 500")
    first = df.orderBy(*[col(c) for c in order_by]).limit(rows)
    return first.select(*[
        (F.when(~F.isnan(col(f.name)) & (F.abs(col(f.name)) != float("inf")), col(f.name)).alias(f.name)
         if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name))
        for f in first.schema.fields
    ])


def read_collection(spark: SparkSession, sources: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """Name -> DataFrame for a set of sources; the first one is the primary table.

    Each source is a mapping of ``read_source`` arguments.
    """
    return {name: read_source(spark, **dict(spec)) for name, spec in sources.items()}


def standalone_datasets(datasets: DataFrame) -> DataFrame:
    """Dataset rows that belong to no collection."""
    kind = F.col("source_type")
    return datasets.filter(kind.isNull() | (kind == "standalone"))


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Name, path and size of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("artifact_name"),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )

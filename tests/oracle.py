"""Run a registered query in Spark and its SQL twin in DuckDB and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def data_folder(scale: str) -> str:
    return os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), f"sf{scale}")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if hasattr(value, "as_tuple"):
        value = float(value) if value != value.to_integral_value() else float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_columns, spark_rows, sql_columns, sql_rows) -> str | None:
    """None when equal, else a short text on the first difference."""
    a_names, a = rows_of(spark_columns, spark_rows)
    b_names, b = rows_of(sql_columns, sql_rows)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}; only spark {sorted(set(a) - set(b), key=repr)[:2]}, only sql {sorted(set(b) - set(a), key=repr)[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {a_names} spark {bad[0][0]} sql {bad[0][1]}"
    return None

import math

from pyspark.sql import types as T

from tablewright.functions.missing import NA_TEXTS, finite_or_null_deep, normalize_missing
from tablewright.operators.profile import introspect
from tablewright.plans.schema import columns_by_kind, flatten_struct, table_prefix
from tablewright.sources.readers import (
    infer_types, list_artifacts, preview, read_collection, read_csv, read_log_lines, read_report, read_source,
)
from tablewright.sources.writers import csv_round_trip, write_table


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, math.nan, "NA"), (2, 1.5, "x"), (3, None, "")], "a int, b double, c string")
    out = {r.a: r for r in normalize_missing(df, NA_TEXTS).collect()}
    assert out[1].b is None and out[1].c is None and out[2].b == 1.5 and out[3].c is None


def test_finite_deep(spark):
    df = spark.createDataFrame(
        [(1, [1.0, math.inf], (math.nan, 2))], "a int, b array<double>, s struct<x:double,y:int>")
    row = finite_or_null_deep(df).first()
    assert row.b == [1.0, None] and row.s.x is None and row.s.y == 2


def test_csv_with_na_texts_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,v,flag,t\n1,NA,True,"a,""b"""\n2,2.5,false,NULL\n3,n/a,True,NaN\n', encoding="utf-8")
    df = read_csv(spark, str(path), infer=True)
    assert [f.dataType for f in df.schema.fields] == [T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()]
    rows = {r.id: r for r in df.collect()}
    assert rows[1].v is None and rows[1].t == 'a,"b"' and rows[2].t is None and rows[3].t is None


def test_csv_schema_turns_bad_text_to_null(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,v\n1,oops\n2,7\n", encoding="utf-8")
    df = read_csv(spark, str(path), schema="id bigint, v double")
    assert {r.id: r.v for r in df.collect()} == {1: None, 2: 7.0}


def test_infer_all_null_column_is_text(spark):
    df = spark.createDataFrame([("1", None)], "a string, b string")
    assert infer_types(df) == {"a": T.LongType(), "b": T.StringType()}


def test_csv_round_trip_keeps_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "é\"q", None), (2, None, "", True)], "a bigint, b double, c string, d boolean")
    back = csv_round_trip(df, str(tmp_path / "out"))
    rows = {r.a: r for r in back.collect()}
    assert back.schema == df.schema and rows[1].c == 'é"q' and rows[2].c is None and rows[2].d is True


def test_report_bad_number(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Algorithm,Test_Score\nA,0.9\nB,bad\n", encoding="utf-8")
    rows = {r.Algorithm: r.Test_Score for r in read_report(spark, str(tmp_path / "r.csv"), ["Test_Score"]).collect()}
    assert rows == {"A": 0.9, "B": None}


def test_preview_bounds_and_infinity(spark):
    df = spark.createDataFrame([(i, math.inf if i == 0 else float(i)) for i in range(5)], "a int, b double")
    assert [r.b for r in preview(df, ["a"], 2).collect()] == [None, 1.0]
    for bad in (0, 501):
        try:
            preview(df, ["a"], bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_collection_first_is_primary_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id bigint, t string")
    for kind in ("parquet", "json", "orc"):
        write_table(df, str(tmp_path / kind), kind)
    tables = read_collection(spark, {k: {"kind": k, "path": str(tmp_path / k)} for k in ("parquet", "json", "orc")})
    assert next(iter(tables)) == "parquet"
    assert all(t.count() == 1 for t in tables.values())
    assert read_source(spark, "json", str(tmp_path / "json"), schema="id int").columns == ["id"]


def test_log_lines_keep_order(spark, tmp_path):
    (tmp_path / "job.log").write_text("\n".join(f"line {i}" for i in range(200)) + "\n\n", encoding="utf-8")
    lines = read_log_lines(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.line for r in lines] == [f"line {i}" for i in range(200)]


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    row = list_artifacts(spark, str(tmp_path)).first()
    assert (row.artifact_name, row.file_size_bytes) == ("a.bin", 5)


def test_kinds_prefix_flatten(spark):
    df = spark.createDataFrame([], "a int, b string, c timestamp, d boolean, e date, f decimal(5,2)")
    assert columns_by_kind(df) == {"numeric": ["a", "f"], "categorical": ["b"], "datetime": ["c", "e"], "other": ["d"]}
    assert table_prefix("bureau") == "BUREAU_" and table_prefix("customers_of_the_world") == "CUST_OF_THE_"
    assert table_prefix("transactions") == "TRANSACT_"
    nested = spark.createDataFrame([((1, (2,)),)], "s struct<x:int,t:struct<y:int>>")
    assert flatten_struct(nested).columns == ["s.x", "s.t.y"]


def test_introspect_empty_and_dates(spark):
    empty = introspect(spark.createDataFrame([], "a int, b string")).collect()
    assert {r.name: (r.unique_count, r.null_count) for r in empty} == {"a": (0, 0), "b": (0, 0)}
    df = spark.createDataFrame([(i, f"2024-01-{i + 1:02d}", "2024-13-45") for i in range(9)], "i int, d string, t string")
    rows = {r.name: r for r in introspect(df, ["i"], 3).collect()}
    assert rows["d"].display_type == "DATE" and rows["t"].display_type == "VARCHAR"
    assert rows["i"].is_potential_key and rows["i"].sample_values == '["0","1","2"]'

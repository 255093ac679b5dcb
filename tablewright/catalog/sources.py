"""S: sources and sinks."""

from pyspark.sql import functions as F

from ..operators.profile import introspect
from ..session import scratch_path
from ..sources.readers import (
    preview, read_collection, read_csv, read_key_column, read_log_lines, read_report, read_source,
    read_summary, standalone_datasets,
)
from ..sources.writers import csv_round_trip, write_csv, write_table
from .base import orders_with_holes, query, report, table, ts


@query("s1_csv_scan", """
SELECT count(*) AS n, 5 AS n_columns, sum(c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS balance,
       count(DISTINCT c_name) AS names FROM customer""", digits=2)
def csv_scan(spark, sf):
    path = scratch_path(spark, "customer_csv")
    write_csv(table(spark, sf, "customer"), path)
    df = read_csv(spark, path, infer=True)
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(len(df.columns)).alias("n_columns"),
                  F.sum("c_custkey").alias("keys"), F.sum("c_acctbal").alias("balance"),
                  F.count_distinct("c_name").alias("names"))


@query("s2_key_column_scan", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_keys FROM orders")
def key_column_scan(spark, sf):
    keys = read_key_column(spark, f"{sf}/orders.parquet", "o_custkey")
    return keys.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_keys"))


@query("s4_preview", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {ts('o_orderdate')} AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 20""")
def first_page(spark, sf):
    return preview(table(spark, sf, "orders"), ["o_orderkey"], 20)


@query("s5_csv_sink", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, {ts('o_orderdate')} AS o_orderdate
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
      CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)""")
def csv_sink(spark, sf):
    return csv_round_trip(orders_with_holes(spark, sf), scratch_path(spark, "orders_csv"))


@query("s5_csv_text", """
SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM (
  SELECT doc_id, concat(text, chr(10), '"quoted, ', lang, '"', chr(10)) AS text, lang, source, n_chars FROM documents)""")
def csv_text(spark, sf):
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", "concat(text, chr(10), '\"quoted, ', lang, '\"', chr(10)) AS text", "lang", "source", "n_chars")
    return csv_round_trip(docs, scratch_path(spark, "documents_csv")).withColumn("text", F.md5("text"))


@query("s1_csv_reordered_schema", """
SELECT c_acctbal, c_custkey, c_name FROM customer""", digits=2)
def csv_reordered(spark, sf):
    path = scratch_path(spark, "customer_by_name")
    write_csv(table(spark, sf, "customer"), path)
    return read_csv(spark, path, schema="c_acctbal double, c_custkey bigint, c_name string")


@query("s6_report_sources", """
WITH r AS (SELECT concat(p_brand, ' (', p_type, ')') AS algorithm, avg(p_size) / 50.0 AS test FROM part
           GROUP BY p_brand, p_type),
     best AS (SELECT algorithm, test FROM r ORDER BY test DESC, algorithm LIMIT 1)
SELECT (SELECT count(*) FROM r) AS n, (SELECT round(sum(test), 4) FROM r) AS total,
       (SELECT algorithm FROM best) AS best_model, (SELECT round(test, 4) FROM best) AS best_score""")
def report_sources(spark, sf):
    folder = scratch_path(spark, "report")
    rows = report(spark, sf)
    write_csv(rows, f"{folder}/report")
    best = rows.orderBy(F.col("Test_Score").desc(), "Algorithm").limit(1).select(
        F.col("Algorithm").alias("best_model"), F.col("Test_Score").alias("best_score"))
    write_table(best, f"{folder}/summary", "json")
    again = read_report(spark, f"{folder}/report", ["Train_Score", "Test_Score"])
    summary = read_summary(spark, f"{folder}/summary", "best_model string, best_score double")
    return summary.select(
        again.agg(F.count(F.lit(1))).scalar().alias("n"), again.agg(F.sum("Test_Score")).scalar().alias("total"),
        "best_model", "best_score")


@query("s7_parquet_source", "SELECT count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier", digits=2)
def parquet_source(spark, sf):
    return read_source(spark, "parquet", f"{sf}/supplier.parquet").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("balance"))


@query("s7_json_source", "SELECT count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier", digits=2)
def json_source(spark, sf):
    suppliers = table(spark, sf, "supplier")
    path = scratch_path(spark, "supplier_json")
    write_table(suppliers, path, "json")
    return read_source(spark, "json", path, schema=suppliers.schema).agg(
        F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("balance"))


@query("s8_log_source", """
SELECT job, count(*) AS n, count(DISTINCT line) AS n_texts FROM (
  SELECT CAST(user_id % 10 AS VARCHAR) AS job,
         CASE WHEN event_type = 'signup' THEN 'Training' ELSE event_type END AS line FROM events) GROUP BY job""")
def log_source(spark, sf):
    path = scratch_path(spark, "logs")
    lines = table(spark, sf, "events").selectExpr(
        "CAST(user_id % 10 AS STRING) AS job", "CASE WHEN event_type = 'signup' THEN 'Training' ELSE event_type END AS value")
    lines.write.partitionBy("job").text(path)
    back = read_log_lines(spark, path)
    return back.withColumn("job", F.regexp_extract("file", r"job=(\d+)/", 1)).groupBy("job").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("n_texts"))


@query("s9_collection_ingest", """
SELECT 'customer' AS table_name, 'primary' AS role, count(*) AS n, 5 AS n_columns FROM customer UNION ALL
SELECT 'orders', 'related', count(*), 6 FROM orders UNION ALL SELECT 'nation', 'related', count(*), 3 FROM nation""")
def collection_ingest(spark, sf):
    names = ["customer", "orders", "nation"]
    tables = read_collection(spark, {n: {"kind": "parquet", "path": f"{sf}/{n}.parquet"} for n in names})
    out = None
    for i, (name, df) in enumerate(tables.items()):
        row = introspect(df).agg(F.count(F.lit(1)).alias("n_columns")).select(
            F.lit(name).alias("table_name"), F.lit("primary" if i == 0 else "related").alias("role"),
            df.agg(F.count(F.lit(1))).scalar().alias("n"), "n_columns")
        out = row if out is None else out.union(row)
    return out


@query("s10_standalone_datasets", """
SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0""")
def standalone(spark, sf):
    datasets = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'standalone' ELSE 'collection' END AS source_type")
    return standalone_datasets(datasets).select("id")



"""A: grouped aggregation."""

from pyspark.sql import functions as F

from ..operators import aggregate as a
from ..operators.profile import introspect
from ..plans.collection import Relationship, auto_aggregations, join_columns
from .base import ORDERS_WITH_COPIES, ORDERS_WITH_HOLES, orders_with_copies, orders_with_holes, query, r, table, ts

_G = f"FROM {ORDERS_WITH_HOLES} WHERE o_custkey IS NOT NULL GROUP BY o_custkey"


def _agg(spark, sf, column, *functions):
    out, _ = a.aggregate_table(orders_with_holes(spark, sf), "o_custkey", "", [{"column": column, "functions": list(functions)}],
                               order_by=["o_orderkey"])
    return out


@query("a0_aggregate_table", f"""
SELECT o_custkey, {r('coalesce(sum(o_totalprice), 0)')} AS "O_o_totalprice_sum", {r('avg(o_totalprice)')} AS "O_o_totalprice_mean",
  {r('median(o_totalprice)')} AS "O_o_totalprice_median", max(o_totalprice) AS "O_o_totalprice_max",
  {r('stddev_samp(o_totalprice)')} AS "O_o_totalprice_std", count(o_orderpriority) AS "O_o_orderpriority_count",
  count(DISTINCT o_orderpriority) AS "O_o_orderpriority_unique_count", count(DISTINCT o_orderstatus) AS "O_o_orderstatus_unique_count" {_G}""")
def aggregate(spark, sf):
    return a.aggregate_table(orders_with_holes(spark, sf), "o_custkey", "O_", [
        {"column": "o_totalprice", "functions": ["sum", "mean", "median", "max", "std"]},
        {"column": "o_orderpriority", "functions": ["count", "nunique", "sum"]},
        {"column": "o_orderstatus", "functions": ["unique_count", "no_such_function"]},
        {"column": "absent", "functions": ["sum"]},
    ], order_by=["o_orderkey"])[0]


@query("a1_sum", f"SELECT o_custkey, {r('coalesce(sum(o_totalprice), 0)')} AS o_totalprice_sum {_G}")
def total(spark, sf):
    return _agg(spark, sf, "o_totalprice", "sum")


@query("a2_mean", f"SELECT o_custkey, {r('avg(o_totalprice)')} AS o_totalprice_mean {_G}")
def mean(spark, sf):
    return _agg(spark, sf, "o_totalprice", "mean")


@query("a3_median", f"SELECT o_custkey, {r('median(o_totalprice)')} AS o_totalprice_median {_G}")
def median(spark, sf):
    return _agg(spark, sf, "o_totalprice", "median")


@query("a4_max", f"SELECT o_custkey, max(o_totalprice) AS o_totalprice_max {_G}")
def largest(spark, sf):
    return _agg(spark, sf, "o_totalprice", "max")


@query("a5_min", f"SELECT o_custkey, min(o_totalprice) AS o_totalprice_min {_G}")
def smallest(spark, sf):
    return _agg(spark, sf, "o_totalprice", "min")


@query("a6_count", f"SELECT o_custkey, count(o_totalprice) AS o_totalprice_count {_G}")
def count(spark, sf):
    return _agg(spark, sf, "o_totalprice", "count")


@query("a7_unique_count", f"SELECT o_custkey, count(DISTINCT o_orderpriority) AS o_orderpriority_unique_count {_G}")
def unique(spark, sf):
    return _agg(spark, sf, "o_orderpriority", "unique_count")


@query("a8_std", f"SELECT o_custkey, {r('stddev_samp(o_totalprice)')} AS o_totalprice_std {_G}")
def std(spark, sf):
    return _agg(spark, sf, "o_totalprice", "std")


@query("a9_variance", f"SELECT o_custkey, round(var_samp(o_totalprice) / 1e6, 3) AS o_totalprice_variance {_G}", digits=3)
def variance(spark, sf):
    return _agg(spark, sf, "o_totalprice", "variance").withColumn(
        "o_totalprice_variance", F.col("o_totalprice_variance") / 1e6)


@query("a10_first", f"SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice IS NOT NULL) AS o_totalprice_first {_G}")
def first(spark, sf):
    return _agg(spark, sf, "o_totalprice", "first")


@query("a11_last", f"SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice IS NOT NULL) AS o_totalprice_last {_G}")
def last(spark, sf):
    return _agg(spark, sf, "o_totalprice", "last")


@query("a10_first_in_file_order", f"""
SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice IS NOT NULL) AS o_totalprice_first,
  arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice IS NOT NULL) AS o_totalprice_last {_G}""")
def in_file_order(spark, sf):
    # The file is in order of o_orderkey; shuffled rows still know their place in it.
    out, _ = a.aggregate_table(orders_with_holes(spark, sf).repartition(64), "o_custkey", "", [{"column": "o_totalprice", "functions": ["first", "last"]}])
    return out


@query("a12_mode", f"""
SELECT o_custkey, o_orderpriority AS o_orderpriority_mode FROM (
  SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY
    CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END, n DESC, o_orderpriority) AS rn FROM (
    SELECT o_custkey, o_orderpriority, count(*) AS n FROM {ORDERS_WITH_HOLES} WHERE o_custkey IS NOT NULL
    GROUP BY o_custkey, o_orderpriority)) WHERE rn = 1""")
def mode(spark, sf):
    return _agg(spark, sf, "o_orderpriority", "mode")


@query("a14_auto_aggregations", f"""
SELECT o_custkey, {r('sum(o_totalprice)')} AS "ORDERS_o_totalprice_sum", {r('avg(o_totalprice)')} AS "ORDERS_o_totalprice_mean",
       max(o_totalprice) AS "ORDERS_o_totalprice_max", count(DISTINCT o_orderstatus) AS "ORDERS_o_orderstatus_unique_count",
       count(DISTINCT o_orderpriority) AS "ORDERS_o_orderpriority_unique_count" FROM (SELECT * REPLACE (floor(o_totalprice / 1000) AS o_totalprice) FROM orders) GROUP BY o_custkey""")
def auto(spark, sf):
    # The key column carries the mark _id, as in real collections.  Prices in whole thousands repeat at any
    # scale; a column without repeats would count as a key and be left out.
    tables = {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders").withColumnRenamed("o_custkey", "cust_id").withColumn(
        "o_totalprice", F.floor(F.col("o_totalprice") / 1000).cast("double"))}
    profiles = {"orders": [row.asDict() for row in introspect(tables["orders"]).collect()]}
    keys = join_columns([Relationship("customer", "orders", "c_custkey", "cust_id")])
    config = auto_aggregations(tables, profiles, "customer", keys)[0]
    out, _ = a.aggregate_table(tables["orders"], config.group_by, config.prefix, config.features)
    return out.withColumnRenamed("cust_id", "o_custkey")


@query("a15_duplicate_rows", f"""
SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {ORDERS_WITH_COPIES})) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {ORDERS_WITH_COPIES})) AS duplicates FROM {ORDERS_WITH_COPIES}""")
def duplicates(spark, sf):
    return a.duplicate_counts(orders_with_copies(spark, sf))


@query("a16_drop_duplicates", f"SELECT DISTINCT o_orderkey, o_custkey, o_totalprice, {ts('o_orderdate')} AS o_orderdate FROM {ORDERS_WITH_COPIES}")
def dropped(spark, sf):
    return a.drop_duplicate_rows(orders_with_copies(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))


@query("a18_counts_by_two_keys", f"""
SELECT CASE WHEN g = 3 THEN 'total' WHEN g = 1 THEN 'event_type' ELSE 'kind' END AS section,
       CASE WHEN g = 1 THEN event_type WHEN g = 2 THEN kind END AS value, total, {ts('last_at')} AS last_at FROM (
  SELECT event_type, kind, grouping(event_type, kind) AS g, count(*) AS total, max(ts) AS last_at
  FROM (SELECT event_type, CAST(user_id % 4 AS VARCHAR) AS kind, ts FROM events)
  GROUP BY GROUPING SETS ((event_type), (kind), ()))""")
def two_keys(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_type", "CAST(user_id % 4 AS STRING) AS kind", "ts")
    return a.counts_by_two_keys(events, "event_type", "kind", "ts")


@query("a19_status_counts", """
SELECT count(*) AS total, count(*) FILTER (WHERE o_totalprice > 250000) AS big, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
       count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders""")
def statuses(spark, sf):
    orders = table(spark, sf, "orders").withColumn("big", F.col("o_totalprice") > 250000)
    return a.count_statuses(orders, "o_orderstatus", ["F", "O", "P"], ["big"])

"""P, O, U: selections, filters, paging, set operations."""

from pyspark.sql import functions as F

from ..operators import projection as p
from ..operators.correlation import pair_correlations
from ..operators.evaluation import downsample
from ..operators.ranking import running
from .base import ORDERS_WITH_HOLES, REPORT_SQL, numbers, orders_with_holes, query, r, report, table, ts


@query("p1_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric(spark, sf):
    return p.select_kind(table(spark, sf, "orders"), "numeric")


@query("p1_categorical_columns", "SELECT c_name, c_mktsegment FROM customer")
def categorical(spark, sf):
    return p.select_kind(table(spark, sf, "customer"), "categorical")


@query("p2_rename_columns", 'SELECT s_suppkey AS "s.suppkey", s_name, s_nationkey, s_acctbal AS "s.acctbal" FROM supplier')
def rename(spark, sf):
    names = {"s_suppkey": "s.suppkey", "s_acctbal": "s.acctbal", "absent": "x"}
    return p.rename_columns(table(spark, sf, "supplier"), names)


@query("p4_drop_rows", f"""
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {ORDERS_WITH_HOLES}
WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""", digits=2)
def drop_rows(spark, sf):
    return p.handle_missing(orders_with_holes(spark, sf), "drop_rows").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("p5_fill_zero", f"""
SELECT o_orderkey, coalesce(o_custkey, 0) AS o_custkey, o_orderstatus, coalesce(o_totalprice, 0.0) AS o_totalprice,
       {ts('o_orderdate')} AS o_orderdate, o_orderpriority FROM {ORDERS_WITH_HOLES}""")
def fill_zero(spark, sf):
    return p.handle_missing(orders_with_holes(spark, sf), "fill_zero")


@query("p6_keep_missing", f"SELECT count(*) AS n, count(o_custkey) AS keys FROM {ORDERS_WITH_HOLES}")
def keep(spark, sf):
    return p.handle_missing(orders_with_holes(spark, sf), "keep").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("keys"))


@query("p7_equality_filters", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'""")
def equality(spark, sf):
    found = p.filter_equal(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="5-LOW", o_custkey=None)
    return found.select("o_orderkey", "o_custkey")


@query("p8_text_search", """
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%RED%' OR p_brand ILIKE '%RED%'""")
def search(spark, sf):
    return p.search_text(table(spark, sf, "part"), "RED", ["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name")


@query("p9_row_errors", f"""
SELECT o_orderkey AS "row", CASE WHEN o_custkey IS NULL THEN 'Missing required field: o_custkey'
       ELSE 'Missing required field: o_totalprice' END AS error
FROM {ORDERS_WITH_HOLES} WHERE o_custkey IS NULL OR o_totalprice IS NULL ORDER BY o_orderkey LIMIT 50""")
def row_errors(spark, sf):
    checked = p.validate_rows(orders_with_holes(spark, sf), ["o_custkey", "o_totalprice"])
    return p.error_rows(checked, "o_orderkey")


@query("p9_good_rows", f"""
SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM {ORDERS_WITH_HOLES}
WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def good_rows(spark, sf):
    checked = p.validate_rows(orders_with_holes(spark, sf), ["o_custkey", "o_totalprice"])
    return p.good_rows(checked).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("p10_rule_violations", f"""
WITH t AS {ORDERS_WITH_HOLES}
SELECT 'o_custkey' AS "column", 'required' AS rule, count(*) FILTER (WHERE o_custkey IS NULL) AS violations,
       count(*) AS total_rows FROM t UNION ALL
SELECT 'o_totalprice', 'min', count(*) FILTER (WHERE o_totalprice < 50000), count(*) FROM t UNION ALL
SELECT 'o_totalprice', 'max', count(*) FILTER (WHERE o_totalprice > 400000), count(*) FROM t UNION ALL
SELECT 'o_orderstatus', 'options', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FROM t""")
def violations(spark, sf):
    return p.rule_violations(orders_with_holes(spark, sf), [
        {"column": "o_custkey", "required": True},
        {"column": "o_totalprice", "min": 50000.0, "max": 400000.0},
        {"column": "o_orderstatus", "options": ["F", "O"]},
    ])


@query("p11_align_columns", "SELECT s_acctbal, 0 AS missing, s_suppkey FROM supplier")
def align(spark, sf):
    return p.align_columns(table(spark, sf, "supplier"), ["s_acctbal", "missing", "s_suppkey"])


@query("o1_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def head(spark, sf):
    return p.first_rows(table(spark, sf, "orders"), ["o_orderkey"], 500).select("o_orderkey", "o_totalprice")


@query("o2_newest_first", f"""
SELECT o_orderkey, {ts('o_orderdate')} AS o_orderdate FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey DESC
LIMIT 50 OFFSET 100""")
def newest(spark, sf):
    return p.newest_first(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 50, 100).select(
        "o_orderkey", "o_orderdate")


@query("o3_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def one_page(spark, sf):
    return p.page(table(spark, sf, "customer"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 3, 20).select(
        "c_custkey", "c_acctbal")


@query("o3_page_info", """
SELECT 3 AS page, 20 AS "pageSize", count(*) AS "totalItems", greatest(1, ceil(count(*) / 20.0))::BIGINT AS "totalPages"
FROM customer""")
def pages(spark, sf):
    return p.page_info(table(spark, sf, "customer"), 3, 20)


@query("o4_top_by_magnitude", f"""
SELECT * FROM (
  SELECT 'l_quantity' AS column1, 'mirrored' AS column2, {r('corr(l_quantity, -2 * l_quantity + l_tax)')} AS correlation FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'net', {r('corr(l_extendedprice, l_extendedprice * (1 - l_discount))')} FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_extendedprice', {r('corr(l_quantity, l_extendedprice)')} FROM lineitem
) ORDER BY abs(correlation) DESC LIMIT 2""")
def strongest(spark, sf):
    pairs = pair_correlations(numbers(spark, sf)).filter("correlation IS NOT NULL")
    return p.top_by_magnitude(pairs, "correlation", 2, ["i", "j"]).select("column1", "column2", "correlation")


@query("o5_top_of_report", f"""
SELECT "Algorithm", {r('"Test_Score"')} AS "Test_Score" FROM {REPORT_SQL} t ORDER BY t."Test_Score" DESC, "Algorithm" LIMIT 10""")
def top_report(spark, sf):
    return report(spark, sf).orderBy(F.col("Test_Score").desc(), "Algorithm").limit(10).select("Algorithm", "Test_Score")


@query("o6_even_downsampling", """
WITH n AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS position
           FROM (SELECT DISTINCT o_totalprice FROM orders)),
     s AS (SELECT max(position) AS last FROM n),
     w AS (SELECT DISTINCT CASE WHEN last < 100 THEN i WHEN i = 99 THEN last
                                ELSE floor(i * (last::DOUBLE / 99.0::DOUBLE))::BIGINT END AS spot
           FROM range(100) t(i), s)
SELECT position::BIGINT AS position, v FROM n WHERE position IN (SELECT spot FROM w)""")
def even(spark, sf):
    values = table(spark, sf, "orders").select(F.col("o_totalprice").alias("v")).distinct()
    placed = running(values, [], ["v"], sums={"place": F.lit(1).cast("bigint")})
    return downsample(placed.select((F.col("place") - 1).alias("position"), "v"),
                      last=values.agg(F.count(F.lit(1)) - 1).scalar())


@query("u1_common_keys", """
SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey + 750 FROM orders)""")
def common(spark, sf):
    shifted = table(spark, sf, "orders").selectExpr("o_custkey + 750 AS o_custkey")
    return p.common_keys(table(spark, sf, "customer"), shifted, "c_custkey", "o_custkey")


@query("u2_keys_on_one_side", """
SELECT 'left' AS side, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 750 FROM orders)
UNION ALL SELECT DISTINCT 'right', o_custkey + 750 FROM orders WHERE o_custkey + 750 NOT IN (SELECT c_custkey FROM customer)""")
def one_side(spark, sf):
    shifted = table(spark, sf, "orders").selectExpr("o_custkey + 750 AS o_custkey")
    customers = table(spark, sf, "customer")
    left = p.keys_only_in(customers, shifted, "c_custkey", "o_custkey").select(F.lit("left").alias("side"), "key")
    return left.union(p.keys_only_in(shifted, customers, "o_custkey", "c_custkey").select(F.lit("right"), "key"))


@query("u4_union_history", """
SELECT 'single' AS type, event_id AS id, value AS probability, NULL::BIGINT AS records FROM events WHERE event_type <> 'purchase'
UNION ALL SELECT 'batch', event_id, NULL, user_id FROM events WHERE event_type = 'purchase'""")
def history(spark, sf):
    events = table(spark, sf, "events")
    single = events.filter("event_type <> 'purchase'").selectExpr("'single' AS type", "event_id AS id", "value AS probability")
    batch = events.filter("event_type = 'purchase'").selectExpr("'batch' AS type", "event_id AS id", "user_id AS records")
    return p.union_history(single, batch)

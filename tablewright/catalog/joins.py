"""J: joins, guards, the wide-table build, relationship checks."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import relationships as rel
from ..operators.derive import build_report, build_wide_table, guard_report, warning_rows
from ..operators.profile import introspect
from ..plans.collection import Aggregation, Collection, Relationship
from .base import ORDERS_WITH_HOLES, orders_with_holes, query, r, table


def _orders_customers(spark, sf, how):
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey + 750 AS o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return j.join_tables(orders, customers, "o_custkey", "c_custkey", how, "customer").df


_SIDES = ("(SELECT o_orderkey, o_custkey + 750 AS o_custkey FROM orders) o {} JOIN "
          "(SELECT c_custkey, c_mktsegment FROM customer) c ON o.o_custkey = c.c_custkey")


@query("j1_left_join", f"SELECT o_orderkey, o_custkey, c_mktsegment FROM {_SIDES.format('LEFT')}")
def left(spark, sf):
    return _orders_customers(spark, sf, "left")


@query("j2_inner_join", """
SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""", digits=2)
def inner(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return j.join_tables(items, orders, "l_orderkey", "o_orderkey", "inner").df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("j3_right_join", f"SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_mktsegment FROM {_SIDES.format('RIGHT')}")
def right(spark, sf):
    return _orders_customers(spark, sf, "right")


@query("j4_full_join", f"SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_mktsegment FROM {_SIDES.format('FULL')}")
def full(spark, sf):
    return _orders_customers(spark, sf, "full")


@query("j5_null_safe_join", f"""
SELECT o_orderkey, t.o_custkey, tag FROM {ORDERS_WITH_HOLES} t LEFT JOIN
  (SELECT CASE WHEN c_custkey = 11 THEN NULL ELSE c_custkey END AS k, c_mktsegment AS tag FROM customer) c
  ON t.o_custkey IS NOT DISTINCT FROM c.k""")
def null_safe(spark, sf):
    customers = table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_custkey = 11 THEN NULL ELSE c_custkey END AS k", "c_mktsegment AS tag")
    return j.join_tables(orders_with_holes(spark, sf).select("o_orderkey", "o_custkey"), customers, "o_custkey", "k").df


@query("j6_first_row_per_key", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {ORDERS_WITH_HOLES}) WHERE rn = 1""")
def first_row(spark, sf):
    return j.first_row_per_key(orders_with_holes(spark, sf), "o_custkey", ["o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@query("j6_first_row_in_file_order", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {ORDERS_WITH_HOLES}) WHERE rn = 1""")
def first_row_of_file(spark, sf):
    # The file is in order of o_orderkey; shuffled rows still know their place in it.
    return j.first_row_per_key(orders_with_holes(spark, sf).repartition(64), "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("j6_explosion_check", f"""
SELECT count(*) AS total_rows, count(DISTINCT o_custkey) AS unique_keys,
       {r('count(*) / count(DISTINCT o_custkey)::DOUBLE')} AS rows_per_key,
       count(DISTINCT o_custkey) < count(*) AS explodes FROM {ORDERS_WITH_HOLES}""")
def explosion(spark, sf):
    return j.explosion_check(orders_with_holes(spark, sf), "o_custkey")


@query("j7_key_coercion", """
SELECT 'double' AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL
SELECT 'text', count(*) FROM orders JOIN customer ON o_custkey = c_custkey""")
def coercion(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    out = None
    for kind, cast in (("double", "CAST(o_custkey AS DOUBLE)"), ("text", "CAST(o_custkey AS STRING)")):
        keys = orders.selectExpr(f"{cast} AS key")
        joined = j.join_tables(keys, customers.select("c_custkey"), "key", "c_custkey", "inner").df
        row = joined.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.union(row)
    return out


@query("j7_decimal_keys", """
SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b
ON 9007199254740993::HUGEINT + a.o_orderkey = 9007199254740992::HUGEINT + 2 * b.o_orderkey""")
def decimal_keys(spark, sf):
    orders = table(spark, sf, "orders")
    left = orders.selectExpr("9007199254740993 + o_orderkey AS key", "o_orderkey AS left_key")
    right = orders.selectExpr("CAST(9007199254740992 + 2 * o_orderkey AS DECIMAL(20, 0)) AS other", "o_orderkey AS right_key")
    return j.join_tables(left, right, "key", "other", "inner").df.select("left_key", "right_key")


@query("j8_overlap_rename", """
SELECT c_custkey, c_acctbal, o_orderkey, o_totalprice AS orders_c_acctbal FROM customer
LEFT JOIN orders ON c_custkey = o_custkey""")
def overlap(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_custkey AS c_custkey", "o_orderkey", "o_totalprice AS c_acctbal")
    return j.join_tables(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), orders,
                         "c_custkey", "c_custkey", "left", "orders").df


@query("j9_drop_right_key", """
SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def drop_key(spark, sf):
    return j.join_tables(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"),
                         table(spark, sf, "nation").select("n_nationkey", "n_name"), "s_nationkey", "n_nationkey").df


FLAGSHIP = Collection(
    primary="customer", tables=["customer", "orders", "nation", "region"],
    relationships=[
        Relationship("customer", "orders", "c_custkey", "o_custkey"),
        Relationship("customer", "nation", "c_nationkey", "n_nationkey"),
        Relationship("nation", "region", "n_regionkey", "r_regionkey"),
    ],
    aggregations=[Aggregation("orders", "o_custkey", "ORD_", [
        {"column": "o_totalprice", "functions": ["sum", "mean", "max", "count"]},
        {"column": "o_orderpriority", "functions": ["nunique"]},
    ])],
    order_by={"customer": ["c_custkey"], "orders": ["o_orderkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]},
)


def flagship_tables(spark, sf):
    return {n: table(spark, sf, n) for n in FLAGSHIP.tables}


def _flagship(spark, sf, **options):
    return build_wide_table(FLAGSHIP, flagship_tables(spark, sf), **options)


_FLAGSHIP_SQL = f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       {r('"sum"')} AS "ORD_o_totalprice_sum", {r('mean')} AS "ORD_o_totalprice_mean", "max" AS "ORD_o_totalprice_max",
       n AS "ORD_o_totalprice_count", kinds AS "ORD_o_orderpriority_unique_count", n_name, n_regionkey, r_name
FROM customer LEFT JOIN (
  SELECT o_custkey, sum(o_totalprice) AS "sum", avg(o_totalprice) AS mean, max(o_totalprice) AS "max", count(o_totalprice) AS n,
         count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


@query("j10_wide_table_warnings", """
SELECT * FROM (VALUES ('''orders'': column ''absent'' not found, skipped'), ('''orders'': unknown function ''product'', skipped'), ('''supplier'' is aggregated but no relationship joins it')) AS t(warning)""")
def wide_warnings(spark, sf):
    """Columns and functions that aren't there are skipped, and the build goes on."""
    odd = replace(FLAGSHIP, tables=[*FLAGSHIP.tables, "supplier"], aggregations=[
        Aggregation("orders", "o_custkey", "ORD_", [
            {"column": "o_totalprice", "functions": ["sum", "product"]}, {"column": "absent", "functions": ["sum"]}]),
        Aggregation("supplier", "s_nationkey", "SUP_", [{"column": "s_acctbal", "functions": ["sum"]}]),
    ])
    built = build_wide_table(odd, {**flagship_tables(spark, sf), "supplier": table(spark, sf, "supplier")})
    return warning_rows(built).filter(built.df.agg(F.count("ORD_o_totalprice_sum")).scalar() > 0)


@query("j10_wide_table", _FLAGSHIP_SQL)
def wide(spark, sf):
    return _flagship(spark, sf).df


@query("j10_wide_table_report", """
SELECT count(*) AS rows_before, count(*) AS rows_after, 5 AS columns_before, 13 AS columns_after, 8 AS columns_added,
       3 AS tables_joined FROM customer""")
def wide_report(spark, sf):
    return build_report(_flagship(spark, sf))


@query("j10_wide_table_sampled", f"""
SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys, {r('sum("ORD_o_totalprice_sum")', 2)} AS total
FROM (SELECT c_custkey, coalesce(t, 0) AS "ORD_o_totalprice_sum" FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 300)
      LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)""", digits=2)
def sampled(spark, sf):
    df = _flagship(spark, sf, sample_rows=300, drop_duplicates=True, handle_missing="fill_zero").df
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.sum("ORD_o_totalprice_sum").alias("total"))


_RAW = Collection(
    primary="customer", tables=["customer", "orders"],
    relationships=[Relationship("customer", "orders", "c_custkey", "o_custkey")],
    order_by={"customer": ["c_custkey"], "orders": ["o_orderkey"]},
)


@query("j10_guarded_raw_join", """
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) o
  ON c_custkey = o_custkey AND rn = 1""")
def guarded(spark, sf):
    tables = {n: table(spark, sf, n) for n in _RAW.tables}
    return build_wide_table(_RAW, tables).df.select("c_custkey", "o_orderkey", "o_totalprice")


@query("j10_guard_report", f"""
SELECT 'orders' AS table_name, 'o_custkey' AS key_column, count(*) AS total_rows, count(DISTINCT o_custkey) AS unique_keys,
       {r('count(*) / count(DISTINCT o_custkey)::DOUBLE')} AS rows_per_key,
       count(DISTINCT o_custkey) < count(*) AS explodes FROM orders""")
def guards(spark, sf):
    tables = {n: table(spark, sf, n) for n in _RAW.tables}
    return guard_report(build_wide_table(_RAW, tables))


@query("j11_preaggregated_join", f"""
SELECT p_partkey, coalesce(q, NULL) AS "LINEITEM_l_quantity_sum", n AS "LINEITEM_l_quantity_count" FROM part LEFT JOIN (
  SELECT l_partkey, {r('sum(l_quantity)')} AS q, count(l_quantity) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""")
def preaggregated(spark, sf):
    collection = Collection(
        primary="part", tables=["part", "lineitem"],
        relationships=[Relationship("part", "lineitem", "p_partkey", "l_partkey")],
        aggregations=[Aggregation("lineitem", "l_partkey", "LINEITEM_", [{"column": "l_quantity", "functions": ["sum", "count"]}])])
    tables = {n: table(spark, sf, n) for n in collection.tables}
    return build_wide_table(collection, tables).df.select("p_partkey", "LINEITEM_l_quantity_sum", "LINEITEM_l_quantity_count")


@query("j12_unguarded_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def unguarded(spark, sf):
    tables = {n: table(spark, sf, n) for n in _RAW.tables}
    return build_wide_table(_RAW, tables, guard=False).df.select("c_custkey", "o_orderkey")


def _validation_sql(left, lkey, right, rkey, ltype, rtype, warn):
    return f"""
WITH l AS (SELECT DISTINCT {lkey} AS k FROM {left} WHERE {lkey} IS NOT NULL),
     rr AS (SELECT DISTINCT {rkey} AS k FROM {right} WHERE {rkey} IS NOT NULL),
     s AS (SELECT (SELECT count(*) FROM l) AS lu, (SELECT count(*) FROM rr) AS ru,
                  (SELECT count(*) FROM l SEMI JOIN rr USING (k)) AS m,
                  (SELECT count(*) FROM {left}) AS ln, (SELECT count(*) FROM {right}) AS rn)
SELECT lu AS left_unique_count, ru AS right_unique_count, m AS match_count, lu - m AS orphan_left_count,
       ru - m AS orphan_right_count, ln AS left_rows, rn AS right_rows,
       round(m / greatest(least(lu, ru), 1)::DOUBLE * 100, 2) AS match_percentage,
       CASE WHEN lu = ln AND ru = rn THEN 'one_to_one' WHEN lu = ln THEN 'one_to_many'
            WHEN ru = rn THEN 'many_to_one' ELSE 'many_to_many' END AS relationship_type,
       '{ltype}' AS left_column_dtype, '{rtype}' AS right_column_dtype, {warn} AS warnings FROM s"""


_ORPHANS = ("concat_ws('|', CASE WHEN round(m / greatest(least(lu, ru), 1)::DOUBLE * 100, 2) < 50 THEN concat('Low key match rate (', "
            "round(m / greatest(least(lu, ru), 1)::DOUBLE * 100, 2), '%), possibly wrong join columns') END, CASE WHEN lu > m THEN concat(lu - m, ' keys in left table have no match in right table') END, "
            "CASE WHEN ru > m THEN concat(ru - m, ' keys in right table have no match in left table') END)")


@query("j13_validate_relationship", _validation_sql("customer", "c_custkey", "orders", "o_custkey", "bigint", "bigint", _ORPHANS))
def validate(spark, sf):
    return rel.validate_relationship(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey")


@query("j13_validate_with_orphans", _validation_sql(
    f"{ORDERS_WITH_HOLES}", "(o_custkey + 750)", "customer", "c_custkey", "bigint", "bigint", _ORPHANS))
def validate_orphans(spark, sf):
    shifted = orders_with_holes(spark, sf).selectExpr("o_custkey + 750 AS k")
    return rel.validate_relationship(shifted, table(spark, sf, "customer"), "k", "c_custkey")


@query("j13_validate_large", _validation_sql("part", "p_partkey", "lineitem", "l_partkey", "bigint", "bigint", _ORPHANS))
def validate_large(spark, sf):
    return rel.validate_relationship(table(spark, sf, "part"), table(spark, sf, "lineitem"), "p_partkey", "l_partkey")


@query("j14_orphan_rows", "SELECT o_orderkey FROM orders WHERE o_custkey + 750 NOT IN (SELECT c_custkey FROM customer)")
def orphans(spark, sf):
    shifted = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey + 750 AS o_custkey")
    return j.orphan_rows(shifted, table(spark, sf, "customer"), "o_custkey", "c_custkey").select("o_orderkey")


@query("j15_matched_rows", "SELECT o_orderkey FROM orders WHERE o_custkey + 750 IN (SELECT c_custkey FROM customer)")
def matched(spark, sf):
    shifted = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey + 750 AS o_custkey")
    return j.matched_rows(shifted, table(spark, sf, "customer"), "o_custkey", "c_custkey").select("o_orderkey")


def _profiles(spark, sf):
    """Column profiles of customer (primary), orders, nation and supplier under linkable names."""
    tables = _named_tables(spark, sf)
    out = None
    for name, df in tables.items():
        rows = introspect(df).select(
            F.lit(name).alias("table_name"), F.lit("primary" if name == "customer" else "related").alias("role"),
            "name", "is_potential_key")
        out = rows if out is None else out.union(rows)
    return out


def _named_tables(spark, sf):
    return {
        "customer": table(spark, sf, "customer").selectExpr(
            "c_custkey AS cust_id", "c_nationkey AS nation_id", "c_name AS name", "c_acctbal"),
        "orders": table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS cust_id", "o_totalprice"),
        "nation": table(spark, sf, "nation").selectExpr("n_nationkey AS nation_id", "n_name AS name"),
        "supplier": table(spark, sf, "supplier").selectExpr("s_suppkey", "s_suppkey AS the_cust_id", "s_acctbal"),
    }


@query("j16_suggest_relationships", """
WITH k AS (SELECT count(DISTINCT c_custkey) = count(*) AS cust_key, count(DISTINCT c_nationkey) = count(*) AS nation_key FROM customer)
SELECT 'customer' AS left_table, 'orders' AS right_table, 'cust_id' AS left_column, 'cust_id' AS right_column,
       CASE WHEN cust_key THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence,
       concat(CASE WHEN cust_key THEN 'Primary key' ELSE 'Exact column name' END, ' match: ''cust_id''') AS reason FROM k UNION ALL
SELECT 'customer', 'nation', 'nation_id', 'nation_id', CASE WHEN nation_key THEN 0.95 ELSE 0.9 END,
       concat(CASE WHEN nation_key THEN 'Primary key' ELSE 'Exact column name' END, ' match: ''nation_id''') FROM k UNION ALL
SELECT 'customer', 'supplier', 'cust_id', 'the_cust_id', 0.6, 'ID pattern match: ''cust_id'' ↔ ''the_cust_id''' FROM k""")
def suggest(spark, sf):
    return rel.suggest_relationships(_profiles(spark, sf))


@query("j16_measured_suggestions", """
WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders),
     n AS (SELECT DISTINCT n_nationkey AS k FROM nation), cn AS (SELECT DISTINCT c_nationkey AS k FROM customer),
     s AS (SELECT DISTINCT s_suppkey AS k FROM supplier),
     x AS (
       SELECT 'orders' AS t, (SELECT count(*) FROM c) AS l, (SELECT count(*) FROM o) AS r, (SELECT count(*) FROM c SEMI JOIN o USING (k)) AS m UNION ALL
       SELECT 'nation', (SELECT count(*) FROM cn), (SELECT count(*) FROM n), (SELECT count(*) FROM cn SEMI JOIN n USING (k)) UNION ALL
       SELECT 'supplier', (SELECT count(*) FROM c), (SELECT count(*) FROM s), (SELECT count(*) FROM c SEMI JOIN s USING (k)))
SELECT t AS right_table, m AS match_count, round(m / least(l, r)::DOUBLE * 100, 2) AS match_percentage,
       l - m AS orphan_left_count, r - m AS orphan_right_count FROM x""")
def measured(spark, sf):
    tables = _named_tables(spark, sf)
    return rel.measure_suggestions(rel.suggest_relationships(_profiles(spark, sf)), tables).select(
        "right_table", "match_count", "match_percentage", "orphan_left_count", "orphan_right_count")


@query("j18_collection_review", """
SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS total_input_rows,
       16 AS total_input_columns, 10 AS estimated_output_columns, 4 AS total_tables, 3 AS total_relationships,
       1 AS total_aggregations, concat_ws('|', 'Table ''nation'' has a relationship but no aggregation configured',
       'Table ''region'' has a relationship but no aggregation configured') AS warnings, true AS ready_to_process""")
def review(spark, sf):
    return rel.collection_review(FLAGSHIP, flagship_tables(spark, sf))


@query("r12_collection_listing", """
SELECT c.c_nationkey AS id, (SELECT count(*) FROM customer t WHERE t.c_nationkey = c.c_nationkey) AS total_tables,
       (SELECT count(*) FROM supplier t WHERE t.s_nationkey = c.c_nationkey) AS total_relationships,
       (SELECT count(*) FROM customer t WHERE t.c_nationkey = c.c_nationkey AND t.c_acctbal < 0) AS total_aggregations
FROM (SELECT DISTINCT n_nationkey AS c_nationkey FROM nation) c""")
def listing(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_nationkey AS collection_id", "c_acctbal")
    return rel.collection_listing(
        table(spark, sf, "nation").selectExpr("n_nationkey AS id"), customers,
        table(spark, sf, "supplier").selectExpr("s_nationkey AS collection_id"), customers.filter("c_acctbal < 0"))

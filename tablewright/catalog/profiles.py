"""Q1-Q6, Q13: profiles and data quality."""

from pyspark.sql import functions as F

from ..operators import profile as p
from ..operators.relationships import profile_diff
from .base import HOLES, ORDERS_WITH_HOLES, orders_with_holes, query, r, table

_COLUMNS = [("o_orderkey", "bigint", "INTEGER", "numeric"), ("o_custkey", "bigint", "INTEGER", "numeric"),
            ("o_orderstatus", "string", "VARCHAR", "categorical"), ("o_totalprice", "double", "FLOAT", "numeric"),
            ("o_orderdate", "timestamp_ntz", "DATETIME", "datetime"), ("o_orderpriority", "string", "VARCHAR", "categorical")]

# Holes plus every tenth row twice: missing values and duplicates together.
DIRTY = f"(SELECT {HOLES} FROM orders UNION ALL SELECT {HOLES} FROM orders WHERE o_orderkey % 10 = 0)"


def dirty(spark, sf):
    rows = orders_with_holes(spark, sf)
    return rows.union(rows.filter("o_orderkey % 10 = 0"))


def _per_column(template, source, columns=_COLUMNS):
    """One SELECT per column; {c} name, {t} type, {d} display type, {k} kind, {i} position."""
    return " UNION ALL ".join(
        f"SELECT {template.format(c=c, t=t, d=d, k=k, i=i)} FROM {source}" for i, (c, t, d, k) in enumerate(columns))


@query("q1_summary", """
SELECT count(*) AS total_rows, 6 AS total_columns, 'o_orderkey|o_custkey|o_totalprice' AS "numeric",
       'o_orderstatus|o_orderpriority' AS categorical, 'o_orderdate' AS datetime, '' AS other,
       sum(32 + octet_length(encode(o_orderstatus)) + octet_length(encode(o_orderpriority)))::BIGINT AS estimated_bytes FROM orders""")
def summary(spark, sf):
    return p.summary(table(spark, sf, "orders"))


_MISSING = ("count(*) - count(o_custkey) + count(*) - count(o_totalprice) + count(*) - count(o_orderpriority)")


@query("q2_dataset_info", f"""
SELECT count(*) AS total_rows, 6 AS total_columns, {_MISSING} AS missing_values,
       round(({_MISSING}) * 100.0 / (count(*) * 6), 2) AS missing_percentage,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY})) AS duplicates,
       3 AS numeric_cols, 2 AS categorical_cols, 1 AS datetime_cols FROM {DIRTY}""")
def info(spark, sf):
    return p.dataset_info(dirty(spark, sf))


@query("q2_column_info", _per_column(
    "'{c}' AS name, '{t}' AS dtype, '{k}' AS type, count(*) - count({c}) AS missing, "
    "CASE WHEN '{k}' <> 'numeric' THEN count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END END AS unique_values",
    ORDERS_WITH_HOLES))
def columns(spark, sf):
    return p.column_info(orders_with_holes(spark, sf))


@query("q3_introspect", _per_column(
    "{i} AS position, '{c}' AS name, '{t}' AS dtype, '{d}' AS display_type, count({c}) < count(*) AS nullable, "
    "count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS null_count, "
    "round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percentage, count(DISTINCT {c}) = count(*) AS is_potential_key",
    ORDERS_WITH_HOLES))
def introspection(spark, sf):
    return p.introspect(orders_with_holes(spark, sf))


@query("q3_first_values", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", (SELECT string_agg(v, '|' ORDER BY k) FROM (
  SELECT o_orderkey AS k, {c}::VARCHAR AS v FROM {ORDERS_WITH_HOLES} WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 5)) AS firsts"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def firsts(spark, sf):
    rows = orders_with_holes(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return p.first_values(rows, ["o_orderkey"], 5)


@query("q3_text_columns_whole", """
SELECT 'doc_id' AS name, count(DISTINCT doc_id) AS unique_count, count(DISTINCT doc_id) = count(*) AS is_potential_key FROM documents
UNION ALL SELECT 'text', count(DISTINCT text), count(DISTINCT text) = count(*) FROM documents
UNION ALL SELECT 'lang', count(DISTINCT lang), count(DISTINCT lang) = count(*) FROM documents
UNION ALL SELECT 'source', count(DISTINCT source), count(DISTINCT source) = count(*) FROM documents
UNION ALL SELECT 'n_chars', count(DISTINCT n_chars), count(DISTINCT n_chars) = count(*) FROM documents""")
def texts(spark, sf):
    return p.introspect(table(spark, sf, "documents")).select("name", "unique_count", "is_potential_key")


def _numeric_sql(source, names):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median,
  {r(f'stddev_samp({c})')} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {r(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q25,
  {r(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q75, count(*) - count({c}) AS missing FROM {source}""" for c in names)


@query("q4_numeric_statistics", _numeric_sql(
    "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def numeric(spark, sf):
    return p.numeric_statistics(table(spark, sf, "lineitem"))


@query("q4_numeric_statistics_holes", _numeric_sql(ORDERS_WITH_HOLES, ["o_orderkey", "o_custkey", "o_totalprice"]))
def numeric_holes(spark, sf):
    return p.numeric_statistics(orders_with_holes(spark, sf))


@query("q5_categorical_statistics", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {ORDERS_WITH_HOLES}) AS "unique", {c} AS top, n AS freq,
       (SELECT count(*) - count({c}) FROM {ORDERS_WITH_HOLES}) AS missing
FROM (SELECT {c}, count(*) AS n FROM {ORDERS_WITH_HOLES} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""
    for c in ("o_orderstatus", "o_orderpriority")))
def categorical(spark, sf):
    return p.categorical_statistics(orders_with_holes(spark, sf))


@query("q5b_missing_values", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS count, round((count(*) - count({c})) / count(*)::DOUBLE * 100, 2) AS percent
FROM {ORDERS_WITH_HOLES} HAVING count({c}) < count(*)""" for c, *_ in _COLUMNS))
def missing(spark, sf):
    return p.missing_values(orders_with_holes(spark, sf))


_QUALITY = f"""
WITH q AS (SELECT count(*) AS n, {_MISSING} AS missing,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY})) AS dup FROM {DIRTY}),
     s AS (SELECT *, 100 - missing * 100.0::DOUBLE / (n * 6) AS c, (1 - dup / n::DOUBLE) * 100 AS u FROM q)
"""


@query("q6_quality_report", _QUALITY + """
SELECT round((c + u) / 2, 2) AS overall_quality_score, round(c, 2) AS completeness, round(u, 2) AS uniqueness,
       dup AS duplicate_rows, missing AS missing_values_count, n * 6 AS total_cells FROM s""")
def quality(spark, sf):
    return p.quality_report(dirty(spark, sf))


@query("q6_quality_checks", _QUALITY + """
SELECT 'Data Completeness' AS name, CASE WHEN c >= 95 THEN 'PASS' WHEN c >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status,
       round(c, 2) AS score, printf('%.1f%% of data is complete', c) AS message FROM s UNION ALL
SELECT 'Data Uniqueness', CASE WHEN u >= 99 THEN 'PASS' ELSE 'WARNING' END, round(u, 2),
       concat(dup, ' duplicate rows found') FROM s""")
def checks(spark, sf):
    return p.quality_checks(dirty(spark, sf))


@query("q6b_dataset_quality", _QUALITY + f"""
SELECT n AS total_rows, 6 AS total_columns, dup AS duplicate_rows, {r('100 - c')} AS missing_percentage, {r('c')} AS completeness,
       {r('u')} AS uniqueness, 100.0 AS consistency, round((c + u + 100) / 3, 2) AS overall_quality_score FROM s""")
def dataset_quality(spark, sf):
    return p.dataset_quality(dirty(spark, sf))


@query("q6b_column_quality", _per_column(
    "'{c}' AS name, '{t}' AS data_type, count(*) - count({c}) AS missing_count, "
    "round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_percentage, count(DISTINCT {c}) AS unique_count",
    ORDERS_WITH_HOLES))
def column_quality(spark, sf):
    return p.column_quality(orders_with_holes(spark, sf))


@query("q13_profile_diff", f"""
WITH n AS (SELECT * FROM {ORDERS_WITH_HOLES})
SELECT 'o_orderkey' AS name, 'unchanged' AS change, 'bigint' AS old_dtype, 'bigint' AS new_dtype, 0.0 AS null_percentage_change, 0 AS unique_change FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'o_orderstatus', 'removed', 'string', NULL, NULL, NULL FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'flag', 'added', NULL, 'string', NULL, NULL FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'o_custkey', 'changed', 'bigint', 'bigint', round((count(*) - count(o_custkey)) * 100.0 / count(*), 2),
  count(DISTINCT o_custkey) - (SELECT count(DISTINCT o_custkey) FROM orders) FROM n""")
def diff(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = orders_with_holes(spark, sf).select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("flag"))
    return profile_diff(p.introspect(old), p.introspect(new))

"""Q7-Q12, A17, W2: distribution statistics."""

from pyspark.sql import functions as F

from ..operators import distribution as d
from .base import NUMBERS, NUMBER_NAMES, ORDERS_WITH_HOLES, numbers, orders_with_holes, query, r, table

_N = f"(SELECT {NUMBERS} FROM lineitem)"


def _shape(c, source):
    return f"""
SELECT '{c}' AS "column", count(x) AS n, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi,
       avg((x - a) ** 3) AS m3, avg((x - a) ** 4) AS m4
FROM (SELECT {c}::DOUBLE AS x, avg({c}) OVER () AS a FROM {source}) WHERE x IS NOT NULL"""


_SHAPES = " UNION ALL ".join(_shape(c, _N) for c in NUMBER_NAMES)


@query("q8_distributions", f"""
SELECT "column", {r('skew', 3)} AS skewness, {r('kurt', 3)} AS kurtosis,
  CASE WHEN abs(skew) < 0.5 THEN 'Approximately Symmetric' WHEN skew > 0 THEN 'Right-skewed (Positive skew)'
       WHEN skew < 0 THEN 'Left-skewed (Negative skew)' END AS distribution_type,
  CASE WHEN abs(kurt) < 0.5 THEN 'Mesokurtic (normal-like)' WHEN kurt > 0 THEN 'Leptokurtic (heavy tails)'
       WHEN kurt < 0 THEN 'Platykurtic (light tails)' END AS kurtosis_type,
  {r('hi - lo', 3)} AS value_range, {r('CASE WHEN m <> 0 THEN s / m * 100 ELSE 0 END', 3)} AS coefficient_of_variation
FROM (SELECT *, CASE WHEN hi > lo THEN m3 / s ** 3 END AS skew, CASE WHEN hi > lo THEN m4 / s ** 4 - 3 END AS kurt
      FROM ({_SHAPES}))""", digits=3)
def distributions(spark, sf):
    return d.distributions(numbers(spark, sf))


@query("q9_categorical_distributions", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {ORDERS_WITH_HOLES}) AS unique_values, t AS total_rows,
  (SELECT count(*) - count({c}) FROM {ORDERS_WITH_HOLES}) AS missing_count,
  row_number() OVER (ORDER BY n DESC, {c} NULLS LAST) AS rank, {c} AS value, n AS count, {r('n / t::DOUBLE * 100')} AS percentage
FROM (SELECT {c}, count(*) AS n FROM {ORDERS_WITH_HOLES} GROUP BY {c}), (SELECT count(*) AS t FROM orders)) WHERE rank <= 4"""
    for c in ("o_orderstatus", "o_orderpriority")))
def categories(spark, sf):
    return d.categorical_distributions(orders_with_holes(spark, sf), top_n=4)


@query("a17_value_counts", f"""
SELECT p_name AS value, n AS count, {r('n / t::DOUBLE * 100')} AS percentage, row_number() OVER (ORDER BY n DESC, p_name) AS rank
FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name), (SELECT count(*) AS t FROM part) ORDER BY rank LIMIT 10""")
def value_counts(spark, sf):
    return d.categorical_distributions(table(spark, sf, "part"), 10, ["p_name"]).select("value", "count", "percentage", "rank")


def _histogram_sql(c, source, bins=15):
    return f"""
SELECT '{c}' AS "column", bin::BIGINT AS bin, {r(f'CASE WHEN bin = {bins} THEN hi ELSE lo + bin * w END', 3)} AS low,
  {r(f'CASE WHEN bin + 1 = {bins} THEN hi ELSE lo + (bin + 1) * w END', 3)} AS high,
  printf('%.2f-%.2f', lo + bin * w, CASE WHEN bin + 1 = {bins} THEN hi ELSE lo + (bin + 1) * w END) AS label,
  (SELECT count(*) FROM {source} WHERE {c} >= lo + bin * w AND ({c} < lo + (bin + 1) * w OR bin = {bins - 1})) AS frequency
FROM range({bins}) t(bin), (SELECT lo, hi, (hi - lo) / {bins} AS w FROM (
  SELECT CASE WHEN max({c}) > min({c}) THEN min({c}) ELSE min({c}) - 0.5 END::DOUBLE AS lo,
         CASE WHEN max({c}) > min({c}) THEN max({c}) ELSE max({c}) + 0.5 END::DOUBLE AS hi FROM {source}))"""


@query("q10_histograms", " UNION ALL ".join(_histogram_sql(c, _N) for c in ("l_quantity", "l_extendedprice", "net", "k")), digits=3)
def histograms(spark, sf):
    return d.histograms(numbers(spark, sf), 15, ["l_quantity", "l_extendedprice", "net", "k"])


@query("q10_histogram_statistics", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {r(f'avg({c})', 3)} AS mean, {r(f'median({c})', 3)} AS median, {r(f'stddev_pop({c})', 3)} AS std,
  {r(f'min({c})::DOUBLE', 3)} AS min, {r(f'max({c})::DOUBLE', 3)} AS max, {r(f'quantile_cont({c}::DOUBLE, 0.25)', 3)} AS q1,
  {r(f'quantile_cont({c}::DOUBLE, 0.75)', 3)} AS q3, count(*) AS total_count, count(*) - count({c}) AS missing_count
FROM {ORDERS_WITH_HOLES}""" for c in ("o_custkey", "o_totalprice")), digits=3)
def histogram_statistics(spark, sf):
    return d.histogram_statistics(orders_with_holes(spark, sf), ["o_custkey", "o_totalprice"])


# Fourth powers of the price: a long tail, so there are outliers.
_TAIL = "(SELECT o_orderkey, o_totalprice * o_totalprice * o_totalprice * o_totalprice / 1e18 AS price FROM orders)"


def _tail(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice * o_totalprice * o_totalprice * o_totalprice / 1e18D AS price")


_FENCES = f"""
(SELECT count(price) AS n, avg(price) AS mean, median(price) AS median, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
        q3 - q1 AS iqr, q1 - 1.5 * iqr AS lower_bound, q3 + 1.5 * iqr AS upper_bound FROM {_TAIL})"""


@query("q11_outliers", f"""
SELECT 'price' AS "column", any_value(n) AS n, {r('any_value(mean)', 3)} AS mean, {r('any_value(median)', 3)} AS median,
  {r('any_value(q1)', 3)} AS q1, {r('any_value(q3)', 3)} AS q3, {r('any_value(iqr)', 3)} AS iqr,
  {r('any_value(lower_bound)', 3)} AS lower_bound, {r('any_value(upper_bound)', 3)} AS upper_bound,
  count(*) FILTER (WHERE price < lower_bound OR price > upper_bound) AS outlier_count,
  {r('min(price) FILTER (WHERE price < lower_bound OR price > upper_bound)', 3)} AS min_outlier,
  {r('max(price) FILTER (WHERE price < lower_bound OR price > upper_bound)', 3)} AS max_outlier,
  {r('count(*) FILTER (WHERE price < lower_bound OR price > upper_bound) / any_value(n)::DOUBLE * 100', 3)} AS outlier_percentage
FROM {_TAIL}, {_FENCES}""", digits=3)
def outliers(spark, sf):
    return d.outliers(_tail(spark, sf), ["price"])


@query("q11_outlier_rows", f"SELECT o_orderkey, {r('price', 3)} AS price FROM {_TAIL}, {_FENCES} WHERE price < lower_bound OR price > upper_bound", digits=3)
def outlier_rows(spark, sf):
    return d.outlier_rows(_tail(spark, sf), "price")


@query("q7_normality_moments", f"""
SELECT "column", n AS sample_size, {r('skew', 3)} AS skewness, {r('kurt', 3)} AS kurtosis,
       round(n / 6.0 * (skew ** 2 + kurt ** 2 / 4) / 100, 2) AS jarque_bera_hundreds, 0 AS is_normal
FROM (SELECT "column", n, m3 / s ** 3 AS skew, m4 / s ** 4 - 3 AS kurt FROM (
  {_shape('o_totalprice', 'orders')} UNION ALL {_shape('o_custkey', 'orders')}))""", digits=3)
def normality_moments(spark, sf):
    rows = d.normality(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return rows.select("column", "sample_size", "skewness", "kurtosis",
                       F.round(F.col("jarque_bera") / 100, 2).alias("jarque_bera_hundreds"), "is_normal")


@query("q7_shapiro_wilk")
def shapiro(spark, sf):
    """SQL has no inverse normal; tested against brute force in the unit tests."""
    return d.shapiro_wilk(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("w6_ordered_positions", """
SELECT o_totalprice AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY o_totalprice)::BIGINT AS upto FROM orders GROUP BY o_totalprice""")
def positions(spark, sf):
    from ..operators.ranking import running

    counted = table(spark, sf, "orders").groupBy(F.col("o_totalprice").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return running(counted, [], ["v"], sums={"upto": F.col("n")})


@query("q12_complete_profile", f"""
SELECT 'distributions' AS part, 2 AS n UNION ALL SELECT 'histograms', 30 UNION ALL SELECT 'outliers', 2 UNION ALL
SELECT 'correlations', 1 UNION ALL SELECT 'categorical', (SELECT count(DISTINCT o_orderstatus) FROM orders)""")
def complete(spark, sf):
    parts = d.complete_profile(table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus"))
    out = None
    for name in ("distributions", "histograms", "outliers", "correlations", "categorical"):
        row = parts[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.union(row)
    return out

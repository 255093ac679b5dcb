"""C: correlation and collinearity."""

from pyspark.sql import functions as F

from ..operators import correlation as c
from .base import NUMBERS, NUMBER_NAMES, ORDERS_WITH_HOLES, numbers, orders_with_holes, query, r, table

_N = f"(SELECT {NUMBERS} FROM lineitem)"
_REAL = [x for x in NUMBER_NAMES if x != "k"]


def _pairs_sql(names, source):
    """All pairs: i, j, column1, column2, correlation (null for a constant), n."""
    parts = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            b = names[j]
            constant = "k" in (a, b)
            value = "NULL::DOUBLE" if constant else f"corr({a}, {b})"
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS column1, '{b}' AS column2, {value} AS correlation, "
                         f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}")
    return "(" + " UNION ALL ".join(parts) + ")"


_PAIRS = _pairs_sql(_REAL, _N)
_WITH_K = _pairs_sql(NUMBER_NAMES, _N)


def pairs(spark, sf):
    return c.pair_correlations(numbers(spark, sf), _REAL, listwise=True)


@query("c1_high_pairs", f"""
SELECT least(column1, column2) AS column1, greatest(column1, column2) AS column2, {r('correlation', 3)} AS correlation
FROM {_WITH_K} WHERE abs(correlation) > 0.3""", digits=3)
def high(spark, sf):
    return c.high_pairs(numbers(spark, sf))


_HOLED = _pairs_sql(["o_orderkey", "o_custkey", "o_totalprice"], ORDERS_WITH_HOLES)


@query("c2_pairwise_correlations", f"SELECT column1, column2, {r('correlation')} AS correlation, n FROM {_HOLED}")
def pairwise(spark, sf):
    return c.pair_correlations(orders_with_holes(spark, sf)).select("column1", "column2", "correlation", "n")


@query("c2_enhanced_correlations", f"""
SELECT column1, column2, {r('correlation')} AS correlation, n,
  CASE WHEN abs(correlation) < 0.3 THEN 'Very Weak' WHEN abs(correlation) < 0.5 THEN 'Weak' WHEN abs(correlation) < 0.7 THEN 'Moderate'
       WHEN abs(correlation) < 0.9 THEN 'Strong' WHEN correlation IS NOT NULL THEN 'Very Strong' END AS strength,
  CASE WHEN abs(correlation) > 0.3 THEN 1 ELSE 0 END AS clear FROM {_WITH_K}""")
def enhanced(spark, sf):
    out = c.enhanced_correlations(numbers(spark, sf))
    clear = F.when((F.abs("correlation") > 0.3) & (F.col("significant") == 1), 1).otherwise(0)
    return out.select("column1", "column2", "correlation", "n", "strength", clear.alias("clear"))


def _below(top: str, steps: int) -> str:
    """SQL: the integral from 0 of the density of sqrt(n - 2) times r, for uncorrelated columns, by the midpoint rule."""
    return (f"({top} / {steps} * list_sum(list_transform(range({steps}), "
            f"lambda i: pow(1 - pow((i + 0.5) * {top} / {steps}, 2) / (n - 2), (n - 4) / 2.0))))")


_P = f"""(SELECT *, CASE WHEN abs(correlation) < 0.3 THEN 'Very Weak' WHEN abs(correlation) < 0.5 THEN 'Weak' WHEN abs(correlation) < 0.7 THEN 'Moderate'
    WHEN abs(correlation) < 0.9 THEN 'Strong' ELSE 'Very Strong' END AS strength,
  CASE WHEN abs(correlation) >= 1 THEN 0 ELSE greatest(0, 1 - {_below('least(10, abs(correlation) * sqrt(n - 2))', 5000)} / {_below('10.0', 10000)}) END AS p
FROM {_WITH_K} WHERE correlation IS NOT NULL)"""
_P_COLUMNS = f"i, j, column1, column2, {r('correlation')} AS correlation, n, {r('p')} AS p_value, (p < 0.05)::INT AS significant, strength"


@query("c2_p_values", f"SELECT {_P_COLUMNS} FROM {_P} WHERE p < 0.05")
def p_values(spark, sf):
    return c.significant_pairs(c.enhanced_correlations(numbers(spark, sf)), 0.0)


@query("c2_p_values_of_all_pairs", f"SELECT {_P_COLUMNS} FROM {_P}")
def all_p_values(spark, sf):
    return c.enhanced_correlations(numbers(spark, sf)).filter("correlation IS NOT NULL")


_STRENGTH = ("CASE WHEN abs(correlation) > 0.9 THEN 'Very Strong' WHEN abs(correlation) > 0.7 THEN 'Strong' "
             "WHEN abs(correlation) > 0.5 THEN 'Moderate' WHEN abs(correlation) > 0.3 THEN 'Weak' ELSE 'Very Weak' END")
_CELLS = (f"(SELECT column2 AS x, column1 AS y, correlation FROM {_PAIRS} UNION ALL SELECT column1, column2, correlation FROM {_PAIRS} "
          + " ".join(f"UNION ALL SELECT '{n}', '{n}', 1.0" for n in _REAL) + ")")


@query("c3_correlation_matrix", f"SELECT x, y, {r('correlation')} AS correlation, {r('abs(correlation)')} AS abs_correlation, {_STRENGTH} AS strength FROM {_CELLS}")
def matrix(spark, sf):
    return c.correlation_matrix(pairs(spark, sf), _REAL)


@query("c3_matrix_range", f"SELECT {r('min(correlation)')} AS min_value, {r('max(correlation)')} AS max_value FROM {_CELLS}")
def matrix_range(spark, sf):
    return c.matrix_range(c.correlation_matrix(pairs(spark, sf), _REAL))


# Twenty columns: more than one aggregate takes, so the pairs come from matrix partials.
_WIDE = [f"x{i}" for i in range(20)]
_WIDE_LIST = [f"o_totalprice * {i + 1} + (o_orderkey * {7 * i + 3}) % {11 + 13 * i} * 3000.0 AS x{i}" for i in range(20)]


@query("c3_wide_matrix", f"SELECT column1, column2, {r('correlation')} AS correlation, n FROM "
       + _pairs_sql(_WIDE, f"(SELECT {', '.join(_WIDE_LIST)} FROM orders)"))
def wide(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(*[e.replace("3000.0", "3000.0D") for e in _WIDE_LIST])
    return c.pair_correlations(rows).select("column1", "column2", "correlation", "n")


_FAR = "o_orderkey AS a, 2 * o_orderkey AS b, o_totalprice AS c"


@query("c3_offset_columns", f"""
SELECT width, column1, column2, {r('correlation')} AS correlation, n FROM (VALUES (3), (7)) AS w(width), (
  SELECT 'a' AS column1, 'b' AS column2, corr(a, b) AS correlation, count(*) AS n FROM (SELECT {_FAR} FROM orders)
  UNION ALL SELECT 'a', 'c', corr(a, c), count(*) FROM (SELECT {_FAR} FROM orders))""")
def offset_columns(spark, sf):
    """Columns far from zero, alone and among others."""
    far = ["1e15D + o_orderkey AS a", "1e15D + 2 * o_orderkey AS b", "o_totalprice AS c"]
    more = ["1e15D AS k", "o_custkey AS d", "o_orderkey % 7 AS e", "-o_totalprice AS f"]
    orders, out = table(spark, sf, "orders"), None
    for columns in (far, far + more):
        found = c.pair_correlations(orders.selectExpr(*columns)).filter("column1 = 'a' AND column2 IN ('b', 'c')")
        part = found.select(F.lit(len(columns)).alias("width"), "column1", "column2", "correlation", "n")
        out = part if out is None else out.union(part)
    return out


@query("c3_nan_columns", f"""
SELECT width, {r('corr(a, b)')} AS correlation, count(a) AS n FROM (VALUES (2), (6)) AS w(width),
  (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS a, o_totalprice + o_custkey AS b FROM orders) GROUP BY width""")
def nan_columns(spark, sf):
    pair = ["CASE WHEN o_orderkey % 5 = 0 THEN double('NaN') ELSE o_totalprice END AS a", "o_totalprice + o_custkey AS b"]
    more = ["o_custkey AS c", "o_orderkey AS d", "o_orderkey % 7 AS e", "o_custkey % 5 AS f"]
    orders, out = table(spark, sf, "orders"), None
    for columns in (pair, pair + more):
        found = c.pair_correlations(orders.selectExpr(*columns)).filter("column1 = 'a' AND column2 = 'b'")
        part = found.select(F.lit(len(columns)).alias("width"), "correlation", "n")
        out = part if out is None else out.union(part)
    return out


@query("c4_correlation_pairs", f"""
SELECT column1, column2, {r('correlation')} AS correlation, n, {_STRENGTH} AS strength, 1 AS significant FROM {_PAIRS}
WHERE abs(correlation) >= 0.3""")
def pair_list(spark, sf):
    return c.correlation_pairs(pairs(spark, sf)).select("column1", "column2", "correlation", "n", "strength", "significant")


@query("c5_strong_pairs", f"""
SELECT '0.7' AS bound, column1 AS feature1, column2 AS feature2, {r('correlation')} AS correlation, {_STRENGTH} AS strength FROM {_PAIRS} WHERE abs(correlation) >= 0.7
UNION ALL SELECT '0.9', column1, column2, {r('correlation')}, {_STRENGTH} FROM {_PAIRS} WHERE abs(correlation) >= 0.9""")
def strong(spark, sf):
    p = pairs(spark, sf)
    return c.strong_pairs(p, 0.7).select(F.lit("0.7").alias("bound"), "*").union(
        c.strong_pairs(p, 0.9).select(F.lit("0.9"), "*"))


@query("c6_collinear_pairs", f"""
SELECT column1, column2, {r('correlation')} AS correlation, CASE WHEN abs(correlation) > 0.95 THEN 'CRITICAL' ELSE 'HIGH' END AS redundancy_level,
  CASE WHEN abs(correlation) > 0.95 THEN concat('Consider removing ', column2) ELSE 'Consider removing one of the features' END AS recommendation
FROM {_PAIRS} WHERE abs(correlation) > 0.8""")
def collinear(spark, sf):
    return c.collinear_pairs(pairs(spark, sf))


@query("c7_strength_distribution", f"""
SELECT count(*) FILTER (WHERE a > 0.9) AS very_strong, count(*) FILTER (WHERE a > 0.7 AND a <= 0.9) AS strong,
  count(*) FILTER (WHERE a > 0.5 AND a <= 0.7) AS moderate, count(*) FILTER (WHERE a > 0.3 AND a <= 0.5) AS weak,
  count(*) FILTER (WHERE a <= 0.3) AS very_weak FROM (SELECT abs(correlation) AS a FROM {_PAIRS})""")
def bands(spark, sf):
    return c.strength_distribution(pairs(spark, sf))


@query("c8_correlation_statistics", f"""
SELECT {r('avg(a)')} AS mean_correlation, {r('max(a)')} AS max_correlation, {r('min(a)')} AS min_correlation,
  {r('median(a)')} AS median_correlation, {r('stddev_pop(a)')} AS std_correlation, count(*) AS total_pairs
FROM (SELECT abs(correlation) AS a FROM {_PAIRS})""")
def statistics(spark, sf):
    return c.correlation_statistics(pairs(spark, sf))


_BOTH = f"(SELECT column1 AS feature, correlation FROM {_PAIRS} UNION ALL SELECT column2, correlation FROM {_PAIRS})"
_VIF = f"""(SELECT feature, CASE WHEN r2 >= 0.9999 THEN 100.0::DOUBLE ELSE 1 / (1 - r2 + 0.0001) END AS vif_score
  FROM (SELECT feature, avg(correlation ** 2) AS r2 FROM {_BOTH} GROUP BY feature))"""
_SEVERITY = "CASE WHEN vif_score > 10 THEN 'CRITICAL' WHEN vif_score > 5 THEN 'WARNING' ELSE 'OK' END"


@query("c9_vif", f"""
SELECT feature, {r('vif_score')} AS vif_score, {_SEVERITY} AS severity,
  CASE WHEN vif_score > 10 THEN 'High multicollinearity' WHEN vif_score > 5 THEN 'Moderate multicollinearity' ELSE 'Acceptable' END AS status,
  CASE WHEN vif_score > 10 THEN 'CRITICAL: Remove this feature or its correlated counterpart'
       WHEN vif_score > 5 THEN 'WARNING: Consider feature selection or dimensionality reduction'
       ELSE 'OK: Feature multicollinearity is acceptable' END AS recommendation FROM {_VIF}""")
def vif(spark, sf):
    return c.vif(pairs(spark, sf))


@query("c9_vif_exact", f"""
SELECT 'l_extendedprice' AS feature, {r('1 / (1 - r * r)', 2)} AS vif_score FROM (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS r FROM lineitem)
UNION ALL SELECT 'net', {r('1 / (1 - r * r)', 2)} FROM (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS r FROM lineitem)""", digits=2)
def vif_exact(spark, sf):
    two = c.pair_correlations(numbers(spark, sf), ["l_extendedprice", "net"], listwise=True)
    return c.vif_exact(two).select("feature", "vif_score")


# A column and scaled copies of it: every feature is redundant.
_COPIES = ["a", "b", "d"]
_COPY_PAIRS = _pairs_sql(_COPIES, "(SELECT l_quantity AS a, -2 * l_quantity + l_tax AS b, l_quantity * 3 + l_discount AS d FROM lineitem)")
_COPY_VIF = _VIF.replace(_PAIRS, _COPY_PAIRS)


def copies(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_quantity AS a", "-2 * l_quantity + l_tax AS b", "l_quantity * 3 + l_discount AS d")
    return c.pair_correlations(rows, _COPIES, listwise=True)


@query("c10_problem_features", f"SELECT feature, {r('vif_score', 2)} AS vif_score, {_SEVERITY} AS severity FROM {_COPY_VIF} WHERE vif_score > 5", digits=2)
def problems(spark, sf):
    return c.problem_features(c.vif(copies(spark, sf)))


@query("c10_collinearity_level", f"""
SELECT count(*) FILTER (WHERE vif_score > 10) AS critical, count(*) FILTER (WHERE vif_score > 5 AND vif_score <= 10) AS warnings,
  CASE WHEN count(*) FILTER (WHERE vif_score > 10) > 0 THEN 'HIGH' WHEN count(*) FILTER (WHERE vif_score > 5 AND vif_score <= 10) > 2 THEN 'MODERATE'
       ELSE 'LOW' END AS level FROM {_COPY_VIF}""")
def level(spark, sf):
    return c.collinearity_level(c.vif(copies(spark, sf)))


# Clusters of one or two features: a pair nearer than the cut is one, the rest stand alone.
_NEAR = f"SELECT j AS item, i AS leader FROM {_PAIRS} WHERE 1 - abs(correlation) <= 0.5"


@query("c11_feature_clusters", f"""
SELECT feature, dense_rank() OVER (ORDER BY coalesce(leader, item)) AS cluster
FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(_REAL))}) v(item, feature) LEFT JOIN ({_NEAR}) USING (item)""")
def clusters(spark, sf):
    return c.feature_clusters(pairs(spark, sf))


@query("c12_relationship_insights", f"""
SELECT 'strongest_positive' AS kind, column1 AS feature1, column2 AS feature2, {r('correlation')} AS correlation FROM {_PAIRS} WHERE correlation > 0.7
UNION ALL SELECT 'strongest_negative', column1, column2, {r('correlation')} FROM {_PAIRS} WHERE correlation < -0.7
UNION ALL SELECT 'uncorrelated', column1, column2, {r('correlation')} FROM {_PAIRS} WHERE abs(correlation) < 0.1""")
def insights(spark, sf):
    return c.relationship_insights(pairs(spark, sf))


@query("c13_feature_connectivity", f"""
SELECT feature, count(*) AS total_features, count(*) FILTER (WHERE abs(correlation) > 0.5) AS strongly_correlated,
  {r('count(*) FILTER (WHERE abs(correlation) > 0.5) / count(*)::DOUBLE')} AS connectivity_score FROM {_BOTH} GROUP BY feature""")
def connectivity(spark, sf):
    return c.feature_connectivity(pairs(spark, sf))


@query("c14_collinearity_warnings", f"""
SELECT 'HIGH_VIF' AS type, {_SEVERITY} AS severity, feature, NULL AS other, {r('vif_score', 2)} AS score, NULL::BIGINT AS pair_count FROM {_COPY_VIF} WHERE vif_score > 5
UNION ALL SELECT 'HIGH_CORRELATION_PAIRS', CASE WHEN abs(correlation) > 0.9 THEN 'CRITICAL' ELSE 'HIGH' END, column1, column2, {r('correlation', 2)},
  (SELECT count(*) FROM {_COPY_PAIRS} WHERE abs(correlation) > 0.8) FROM {_COPY_PAIRS} WHERE abs(correlation) > 0.8""", digits=2)
def warnings(spark, sf):
    return c.collinearity_warnings(copies(spark, sf))


@query("c14_collinearity_assessment", f"""
SELECT n AS warning_count, CASE WHEN n = 0 THEN 'No significant multicollinearity issues detected'
  WHEN n = 1 THEN 'Minor multicollinearity issues detected' ELSE 'Significant multicollinearity issues detected - action recommended' END AS overall_assessment
FROM (SELECT (SELECT count(*) FROM {_COPY_VIF} WHERE vif_score > 5) + (SELECT max(CASE WHEN abs(correlation) > 0.8 THEN 1 ELSE 0 END) FROM {_COPY_PAIRS}) AS n)""")
def assessment(spark, sf):
    return c.collinearity_assessment(c.collinearity_warnings(copies(spark, sf)))


@query("c15_complete_analysis", f"""
SELECT 'pairs' AS part, 15 AS n UNION ALL SELECT 'matrix', 36 UNION ALL SELECT 'vif', 6 UNION ALL SELECT 'connectivity', 6
UNION ALL SELECT 'high', (SELECT count(*) FROM {_PAIRS} WHERE abs(correlation) >= 0.7)
UNION ALL SELECT 'collinear', (SELECT count(*) FROM {_PAIRS} WHERE abs(correlation) > 0.8)""")
def complete(spark, sf):
    parts = c.complete_analysis(numbers(spark, sf).drop("k"))
    out = None
    for name in ("pairs", "matrix", "vif", "connectivity", "high", "collinear"):
        row = parts[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.union(row)
    return out

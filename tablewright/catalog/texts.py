"""F: scalar functions."""

from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..functions.missing import finite_or_null_deep
from ..plans.schema import flatten_struct
from .base import LINES_SQL, log_lines, query, r, table



@query("f1_slugify", r"""
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)),
       '[^\w\s-]', '', 'g'), '[\s-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'collection') AS slug
FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '!!' ELSE concat('  ', p_name, ' -- (', p_brand, ')') END AS name
      FROM part)""")
def slugs(spark, sf):
    names = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 50 = 0 THEN '!!' ELSE concat('  ', p_name, ' -- (', p_brand, ')') END AS name")
    return names.select("p_partkey", t.slugify(F.col("name")).alias("slug"))


@query("f3_similar_names", """
SELECT p_partkey, contains(a, b) OR contains(b, a) AS similar
FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[_-]', '', 'g') AS a,
             regexp_replace(lower(split_part(p_name, ' ', 1)), '[_-]', '', 'g') AS b FROM part)""")
def similar(spark, sf):
    parts = table(spark, sf, "part").withColumn("first", F.element_at(F.split("p_name", " "), 1))
    return parts.select("p_partkey", t.similar_names(F.col("p_name"), F.col("first")).alias("similar"))


@query("f4_model_id", """
SELECT DISTINCT regexp_replace(replace(lower(concat(p_brand, ' (', p_type, ')')), ' ', '_'), '[()]', '', 'g') AS id FROM part""")
def ids(spark, sf):
    name = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf, "part").select(t.model_id(name).alias("id")).distinct()


@query("f5_bin_label", "SELECT p_partkey, printf('%.2f-%.2f', p_retailprice, p_retailprice + p_size) AS label FROM part")
def labels(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", n.bin_label(F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size")).alias("label"))


@query("f6_sigmoid", f"SELECT s_suppkey, {r('1 / (1 + exp(-s_acctbal / 1000.0::DOUBLE))')} AS p FROM supplier")
def sigmoids(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", n.sigmoid(F.col("s_acctbal") / 1000.0).alias("p"))


@query("f7_zscore", f"""
SELECT s_suppkey, {r('(s_acctbal - m) / s')} AS z, 0.0 AS flat FROM supplier,
       (SELECT avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS s FROM supplier)""")
def zscores(spark, sf):
    suppliers = table(spark, sf, "supplier")
    fit = suppliers.agg(F.struct(F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("s")).alias("f")).scalar()
    return suppliers.withColumn("_f", fit).select(
        "s_suppkey", n.zscore(F.col("s_acctbal"), F.col("_f.m"), F.col("_f.s")).alias("z"),
        n.zscore(F.col("s_acctbal"), F.col("_f.m"), F.lit(0.0)).alias("flat"))


@query("f8_finite_or_null", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS v,
       CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS kept FROM supplier""")
def finite(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN double('NaN') WHEN s_suppkey % 5 = 0 THEN double('Infinity') "
        "ELSE s_acctbal END AS v", "array(s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN double('-Infinity') ELSE 1.0D END) AS many")
    return finite_or_null_deep(rows).select("s_suppkey", "v", F.size(F.array_compact("many")).alias("kept"))


@query("f9_flatten_struct", 'SELECT s_suppkey, s_name AS "who.name", s_nationkey AS "who.at.nation" FROM supplier')
def flat(spark, sf):
    nested = table(spark, sf, "supplier").select(
        "s_suppkey", F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("at")).alias("who"))
    return flatten_struct(nested)


@query("f10_json_field", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def json(spark, sf):
    props = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", t.json_field(props, "$.k").try_cast("bigint").alias("k"))


@query("f11_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def iso(spark, sf):
    return table(spark, sf, "events").select("event_id", t.iso_timestamp(F.col("ts")).alias("at"))


@query("f12_log_line_extraction", rf"""
SELECT position, coalesce(nullif(regexp_extract(line, 'Training\s+(\w+)\.\.\.', 1), ''),
                          nullif(regexp_extract(line, '✅\s+(\w+):\s+Train=', 1), '')) AS algorithm FROM {LINES_SQL}""")
def extraction(spark, sf):
    return log_lines(spark, sf).select("position", t.algorithm_in_line(F.col("line")).alias("algorithm"))


@query("f13_cut_labels", """
SELECT s_suppkey,
  CASE WHEN v < 0.3 THEN 'Very Weak' WHEN v < 0.5 THEN 'Weak' WHEN v < 0.7 THEN 'Moderate' WHEN v < 0.9 THEN 'Strong' ELSE 'Very Strong' END AS pair,
  CASE WHEN v > 0.9 THEN 'Very Strong' WHEN v > 0.7 THEN 'Strong' WHEN v > 0.5 THEN 'Moderate' WHEN v > 0.3 THEN 'Weak' ELSE 'Very Weak' END AS matrix,
  CASE WHEN v >= 0.85 THEN 'high' WHEN v >= 0.65 THEN 'moderate' ELSE 'low' END AS band,
  CASE WHEN v < 0.03 THEN 'acceptable' WHEN v < 0.08 THEN 'moderate' ELSE 'overfitting' END AS gap
FROM (SELECT s_suppkey, (s_suppkey % 101) / 100.0::DOUBLE AS v FROM supplier)""")
def cuts(spark, sf):
    v = F.col("v")
    rows = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 101) / 100.0).alias("v"))
    return rows.select("s_suppkey", n.pair_strength(v).alias("pair"), n.matrix_strength(v).alias("matrix"),
                       n.confidence_band(v).alias("band"), n.gap_status(v).alias("gap"))

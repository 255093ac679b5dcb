"""The physical plans that matter at scale."""

import re

import pytest

from tablewright.catalog import QUERIES
from tablewright.operators.aggregate import aggregate_table
from tablewright.operators.joins import first_row_per_key, orphan_rows
from tablewright.operators.profile import first_values
from tablewright.operators.ranking import running
from tests.oracle import data_folder

FOLDER = data_folder("0.001")
PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|PythonMapInArrow|FlatMapGroups")
# Where Python is allowed: normal scores, p values, matrix partials and k*k matrices.
MAY_USE_PYTHON = {"q7_shapiro_wilk", "q7_normality_moments", "q12_complete_profile", "o4_top_by_magnitude",
                  "e12_feature_interactions", *(n for n in QUERIES if re.match(r"c\d", n))}
# Fitting and streaming run while the frame is built.
EAGER = ("m14_", "t1_", "t3_streamed", "t4_", "t5_", "t6_", "m1_")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_product_and_no_stray_python(spark, name):
    plan = plan_of(QUERIES[name].build(spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in MAY_USE_PYTHON:
        assert not PYTHON.search(plan)


def test_scan_reads_only_what_is_used(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").filter("o_totalprice > 1000")
    out, _ = aggregate_table(orders, "o_custkey", "", [{"column": "o_totalprice", "functions": ["sum"]}])
    plan = plan_of(out)
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double>", plan)
    assert "PushedFilters: [" in plan and "GreaterThan(o_totalprice,1000.0)" in plan
    assert "partial_sum" in plan


def test_first_row_is_limited_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    plan = plan_of(first_row_per_key(orders, "o_custkey", ["o_orderkey"]))
    limit, shuffle = plan.rindex("WindowGroupLimit"), plan.index("Exchange hashpartitioning")
    assert plan.count("WindowGroupLimit") == 2 and limit > shuffle  # children come later in the text
    assert plan_of(first_values(orders, ["o_orderkey"], 5)).count("WindowGroupLimit") == 2


def test_one_shuffle_for_an_aggregate_with_many_functions(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    out, _ = aggregate_table(orders, "o_custkey", "", [{"column": "o_totalprice", "functions": ["sum", "mean", "min", "max", "std", "count"]}])
    assert plan_of(out).count("Exchange") == 1


def test_running_never_windows_without_keys(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey")
    from pyspark.sql import functions as F

    df = running(orders, [], ["o_orderkey"], sums={"n": F.lit(1).cast("bigint")})
    df.collect()
    plan = plan_of(df)
    # the only window over everything is that of the bucket totals
    windows = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_tot_n" in w for w in windows) == 1


def test_anti_join_reduces_keys_first(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet")
    assert "LeftAnti" in plan_of(orphan_rows(orders, customers, "o_custkey", "c_custkey"))

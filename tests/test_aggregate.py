import pytest
from pyspark.sql import functions as F

from tablewright.operators.aggregate import (
    aggregate_table, created_columns, duplicate_counts, register_agg_function,
)
from tablewright.operators.profile import introspect
from tablewright.plans.collection import Relationship, auto_aggregations, join_columns

ROWS = [(1, 1, None, "a"), (1, 2, 4.0, "b"), (1, 3, 2.0, "b"), (2, 4, None, None), (2, 5, None, "z"), (None, 6, 9.0, "q"),
        (3, 7, 5.0, "c")]


@pytest.fixture
def detail(spark):
    return spark.createDataFrame(ROWS, "k int, o int, v double, t string")


def test_rules(detail):
    out, notes = aggregate_table(detail, "k", "P_", [
        {"column": "v", "functions": ["sum", "mean", "median", "min", "max", "count", "std", "variance", "first", "last"]},
        {"column": "t", "functions": ["nunique", "mode", "first", "last", "sum"]},
        {"column": "gone", "functions": ["sum"]}, {"column": "v", "functions": ["wrong"]},
    ], order_by=["o"])
    rows = {r.k: r for r in out.collect()}
    assert set(rows) == {1, 2, 3}  # a null key is no group
    assert rows[2].P_v_sum == 0 and rows[2].P_v_mean is None and rows[2].P_v_median is None  # all-null group
    assert rows[3].P_v_std is None and rows[3].P_v_variance is None  # one row
    assert rows[1].P_v_median == 3.0 and rows[1].P_v_first == 4.0 and rows[1].P_v_last == 2.0
    assert rows[1].P_t_mode == "b" and rows[2].P_t_mode == "z" and rows[1].P_t_unique_count == 2
    assert len(notes) == 3 and any("text column" in n for n in notes)
    assert created_columns("P_", [{"column": "x_var1", "functions": ["var", "mode"]}]) == ["P_x_var1_variance", "P_x_var1_mode"]


def test_many_distinct_counts_together(spark):
    """Equal values of any type count once, nulls never, and no row is repeated for it."""
    long = "x" * 300
    rows = [(1, 1.0, "a", long, [1], 5), (1, -0.0, "a", long + "y", [1], 5), (1, 0.0, "A", long, [1, 2], None), (1, float("nan"), None, None, None, 6),
            (1, float("nan"), "", long, [], 2**40), (2, None, None, None, None, None), (None, 3.0, "q", "q", [9], 9)]
    df = spark.createDataFrame(rows, "k int, d double, t string, w string, l array<int>, n bigint").repartition(4)
    out, _ = aggregate_table(df, "k", "", [{"column": c, "functions": ["nunique", "count"]} for c in ("d", "t", "w", "l", "n")] + [{"column": "n", "functions": ["max"]}])
    got = {r.k: r for r in out.collect()}
    names = ["d_unique_count", "t_unique_count", "w_unique_count", "l_unique_count", "n_unique_count"]
    assert [got[1][n] for n in names] == [3, 3, 2, 3, 3] and [got[2][n] for n in names] == [0] * 5 and set(got) == {1, 2}
    assert got[1].n_max == 2**40 and got[1].w_count == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    one, _ = aggregate_table(df, "k", "", [{"column": "d", "functions": ["nunique"]}])
    assert {r.k: r.d_unique_count for r in one.collect()} == {1: 3, 2: 0}


def test_errors_and_own_function(detail):
    with pytest.raises(ValueError):
        aggregate_table(detail, "none", "", [{"column": "v", "functions": ["sum"]}])
    with pytest.raises(ValueError):
        aggregate_table(detail, "k", "", [{"column": "t", "functions": ["sum"]}])
    register_agg_function("spread", lambda c, _: F.max(c) - F.min(c), numeric_only=True)
    out, _ = aggregate_table(detail, "k", "", [{"column": "v", "functions": ["spread"]}])
    assert {r.k: r.v_spread for r in out.collect()}[1] == 2.0


def test_first_without_order_follows_scan(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("v")).coalesce(1)
    out, _ = aggregate_table(df, "k", "", [{"column": "v", "functions": ["first", "last"]}])
    assert {(r.k, r.v_first, r.v_last) for r in out.collect()} == {(0, 0, 98), (1, 1, 99)}


def test_duplicates_null_equals_null_and_long_text(spark):
    long = "x" * 500
    df = spark.createDataFrame([(1, None, long), (1, None, long), (1, 0.0, long), (1, -0.0, long), (2, None, long + "y")],
                               "a int, b double, t string")
    row = duplicate_counts(df).first()
    assert (row.total_rows, row.distinct_rows, row.duplicates) == (5, 3, 2)


def test_auto_aggregations(spark):
    loans = spark.createDataFrame(
        [(1, 10, 5.0, "a", 7, None), (1, 11, 6.0, "b", 7, None), (2, 12, 6.0, "b", 7, None)],
        "cust_id int, loan int, amount double, kind string, same int, empty double")
    tables = {"people": spark.createDataFrame([(1,)], "cust_id int"), "loans": loans}
    profiles = {"loans": [r.asDict() for r in introspect(loans).collect()]}
    keys = join_columns([Relationship("people", "loans", "cust_id", "cust_id")])
    config = auto_aggregations(tables, profiles, "people", keys)
    assert len(config) == 1 and config[0].prefix == "LOANS_" and config[0].group_by == "cust_id"
    assert config[0].features == [{"column": "amount", "functions": ["sum", "mean", "max"]},
                                  {"column": "kind", "functions": ["nunique"]}]

"""Reports on tables without some kind of column are empty; builds and readers keep what they are given."""

from statistics import NormalDist

import numpy as np
import pytest

from tablewright.operators import correlation, distribution, joins, profile, relationships
from tablewright.sources.readers import read_csv
from tablewright.sources.writers import csv_round_trip, write_csv


@pytest.fixture(scope="module")
def frames(spark):
    return {
        "text": spark.createDataFrame([("a",), ("b",)], "t string"), "one": spark.createDataFrame([(1.0,), (2.0,)], "x double"),
        "none": spark.createDataFrame([(True,)], "b boolean"), "empty": spark.createDataFrame([], "x double, y double, t string"),
    }


@pytest.mark.parametrize("name", ["text", "one", "none", "empty"])
def test_profiles_and_correlations(frames, name):
    df = frames[name]
    profile.categorical_statistics(df).collect()
    profile.numeric_statistics(df).collect()
    assert correlation.pair_correlations(df).count() in (0, 1)


def test_csv_keeps_line_breaks_and_takes_options(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a\n"b", c'), (2, "c"), (3, None)], "id int, t string")
    assert sorted(map(tuple, csv_round_trip(df, str(tmp_path / "x")).collect())) == sorted(map(tuple, df.collect()))
    write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "y"))
    got = read_csv(spark, str(tmp_path / "y"), schema="b int, a int", multiLine=False, header=True, escape='"').collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "y"), schema="z int")


def test_integers_meet_decimals_exactly(spark):
    left = spark.createDataFrame([(9007199254740993,)], "k bigint")
    right = spark.sql("SELECT CAST(9007199254740992 AS DECIMAL(20, 0)) AS d UNION ALL SELECT CAST(9007199254740993 AS DECIMAL(20, 0))")
    assert joins.join_tables(left, right, "k", "d", "inner").df.count() == 1
    cents = spark.sql("SELECT CAST(9007199254740993.50 AS DECIMAL(22, 2)) AS d")
    assert joins.join_tables(left, cents, "k", "d", "inner").df.count() == 0


def test_no_suggestions_to_measure(spark):
    none = spark.createDataFrame([], "left_table string, right_table string, left_column string, right_column string, confidence double")
    assert relationships.measure_suggestions(none, {}).count() == 0


def test_normal_scores_are_the_inverse_normal():
    inverse = NormalDist().inv_cdf
    for n in (3, 50, 5000, 100_000):
        shares = (np.arange(1, n + 1) - 0.375) / (n + 0.25)
        assert np.allclose(distribution.normal_scores(shares), [inverse(s) for s in shares], rtol=0, atol=1e-9)


def test_a_taken_name_gets_a_number(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k int, v int, r_v int")
    got = joins.join_tables(left, spark.createDataFrame([(1, 9)], "k2 int, v int"), "k", "k2", "left", "r")
    assert got.renamed == {"v": "r_v_2"} and got.df.first().r_v_2 == 9

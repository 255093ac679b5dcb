"""Every query of the library against its SQL twin; rows only where there is none (tests/llm has its own)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tablewright.catalog import QUERIES
from tests.oracle import connect, data_folder, difference

FOLDER = data_folder("0.001")
SLOW = [n for n in QUERIES if n.startswith("m14_") and "naivebayes" not in n and "kmeans" not in n]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SLOW)))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = con.execute(sql)
    assert difference(df.columns, rows, [d[0] for d in result.description], result.fetchall()) is None


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())

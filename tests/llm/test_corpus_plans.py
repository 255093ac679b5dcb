"""Plans of the corpus queries: no products of tables, and no Python where it isn't wanted."""

import re

import pytest

from tablewright.llm import queries as Q
from tests.oracle import data_folder

PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_product(spark, name):
    plan = Q.QUERIES[name](spark, data_folder("0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.startswith(("op4_", "op9_")):
        assert not PYTHON.search(plan)

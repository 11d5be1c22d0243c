from pathlib import Path

import pytest

from amphora.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, compare, name):
    got, want = compare(spark, catalog.QUERIES[name], catalog.SQL[name], FOLDER)
    assert got == want


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(FOLDER)).count() > 0


def test_pushdown_and_pruning(spark):
    if not FOLDER.exists():
        pytest.skip("test tables are not here")
    plan = catalog.QUERIES["graph_nodes"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan

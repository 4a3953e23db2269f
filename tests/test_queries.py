"""Every query against its SQL twin, and a look at every physical plan."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    if name in ORACLES:
        assert compare(got, con.sql(ORACLES[name]).df()) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.count() > 0
    assert {"series_id", "protocol", "model", "subset", "rmse", "skill"} <= set(out.columns)

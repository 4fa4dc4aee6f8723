"""Every registered query of the library builds on sf0.001; physical-plan guards."""

import __spark_entry__ as E
from causeway.plans.registry import REGISTRY
from conftest import SF_SMOKE


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_builds_without_cross_joins(spark):
    E.queries()
    bad = []
    for name, q in REGISTRY.items():
        df = q.build(spark, SF_SMOKE)
        plan = _plan(df)
        if not df.columns or "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert not bad, bad


def test_gram_plan_prunes_and_aggregates_partially(spark):
    plan = _plan(E.queries()["qx1_did_ols"](spark, SF_SMOKE))
    assert "o_custkey,o_totalprice,o_orderdate" in plan.replace(" ", "") or "ReadSchema" in plan
    assert plan.count("HashAggregate") >= 2  # partial + final around one exchange
    assert "MapInPandas" in plan or "PythonMapInArrow" in plan or "MapInArrow" in plan

"""Describing an event is dear, so plans do it once for each."""

import pytest

from obsflow.plans import records


@pytest.mark.parametrize("name", ["d28_semantic_findings", "d26_describe"])
def test_events_are_parsed_once(spark, name):
    """A plain explode put a filter before it, into which Spark copied the whole description; and events were described by the tasks that read them."""
    df = getattr(records, name)(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 1 or plan.count("parseJson") == 1
    assert "RepartitionByExpression [event_id" in plan

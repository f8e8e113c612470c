"""Replay and cost by groups of incidents against the same over frozen rows."""

from datetime import datetime, timedelta

import pytest

from obsflow.operators import cardinality, evidence, replay, windows
from obsflow.plans import records, registry
from obsflow.schema import CardinalityRule, Policy

T0 = datetime(2024, 1, 1)
ACTIVE = Policy("a", "1", 40, "allow", ("user",), (CardinalityRule("api", "*", "user_id", 20, "drop_tag"), CardinalityRule("*", "x*", "odd", 12, "quarantine")))
SHADOW = Policy("s", "2", 30, "allow", ("user",), (CardinalityRule("*", "*", "user_id", 25, "quarantine"),))


def _inputs(spark, repeat=()):
    """Two tenants' events over two hours, some captured twice, with odd tags; overlapping incidents, and some without events."""
    rows = []
    for i in range(900):
        tags = {"user_id": f"u{i % 70}", "odd": ("a|b=c", "", None, f"v{i % 40}")[i % 4], "ctl.note": f"n{i % 3}", "ctl.quarantined": "false"}
        at = T0 + timedelta(seconds=8 * (i // 2))
        rows.append((f"e{i}", "tu"[i % 2], " api" if i % 5 else "web", "xyz"[i % 3], at, at, tags if i % 11 else None, None, 1.5 * i if i % 3 else None, None, "1", None, None))
    rows += [(*r[:5], r[5] + timedelta(seconds=500), *r[6:]) for r in rows[::7]]
    kinds = "event_id string, tenant_id string, source string, event_type string, event_time timestamp, captured_at timestamp, tags map<string,string>, payload string, metric_value double, metric_unit string, schema_version string, schema_url string, correlation_id string"
    spans = [(t, f"i{k}", T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + n)) for t in "tu" for k, (s, n) in enumerate([(0, 900), (30, 900), (1500, 2400), (3000, 900), (90000, 60)])]
    return spark.createDataFrame([*spans, *repeat], "tenant_id string, incident_id string, frozen_from timestamp, frozen_to timestamp"), spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize("held", [200_000, 0])
def test_groups_equal_frozen_rows(spark, monkeypatch, held):
    """``held`` of 0 sends every group the other way."""
    monkeypatch.setattr(windows, "HELD", held)
    inc, captures = _inputs(spark)
    fz = evidence.freeze(inc, captures)
    of = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert of(replay.replay_incidents(inc, captures, ACTIVE, SHADOW)) == of(full := replay.replay(fz, ACTIVE, SHADOW))
    assert any(r.findings and r.shadow_diffs and r.quarantined for r in full.collect())
    assert of(replay.replay_incident_totals(inc, captures, ACTIVE, SHADOW)) == of(replay.replay_totals(full))
    assert of(replay.cost_incidents(inc, captures, ACTIVE, SHADOW)) == of(replay.cost_simulation(fz, ACTIVE, SHADOW))


def test_replay_queries_take_each_event_twice_at_most(spark, monkeypatch):
    """Events go to groups of incidents; laid out by incident they were repeated a dozen times."""
    seen, real = [], windows.stage
    monkeypatch.setattr(windows, "stage", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    records.a12_replay_totals(spark, "/root/testdata/sf0.01")
    sizes = dict(seen)["group-sizes"].agg({"count": "sum"}).collect()[0][0]
    assert sizes <= 2 * 10_000


def test_firewall_deals_tags_once_to_tasks_of_bounded_size(spark, monkeypatch):
    """One exchange by the hourly key, whose partitions grow in number with the events, serves all windows."""
    monkeypatch.setattr(cardinality, "DEALT", 50)
    _, captures = _inputs(spark)
    rows = cardinality.observed(captures)
    assert rows.rdd.getNumPartitions() == -(-captures.count() // 50)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    same = ["tenant_id", "event_id", "dimension", "event_time", "observed", "projected"]
    by_key = cardinality.observe(cardinality.tag_rows(captures.dropDuplicates(["event_id"])))
    at_once = cardinality.observed(captures.dropDuplicates(["event_id"]))
    assert sorted(map(tuple, at_once.select(*same).collect())) == sorted(map(tuple, by_key.select(*same).collect()))


@pytest.mark.parametrize("name", ["d22_evidence_nodes", "d22_evidence_nodes_runs"])
def test_nodes_make_no_edges(spark, monkeypatch, name):
    seen, real = [], evidence.stage
    monkeypatch.setattr(evidence, "stage", lambda df, name: seen.append(name) or real(df, name))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "evidence-facts" in seen and "evidence-edges" not in seen

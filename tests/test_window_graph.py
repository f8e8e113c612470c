"""The graph of windows against the graph of frozen events, and sets that meet in blocks against all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsflow.operators import changes, evidence, window_graph

T0 = datetime(2024, 1, 1)
KINDS = "event_id string, tenant_id string, source string, event_type string, event_time timestamp, captured_at timestamp, tags map<string,string>, payload string, metric_value double, metric_unit string, schema_version string, schema_url string, correlation_id string"


def _inputs(spark):
    """Events of two tenants over two hours, some at one time, some twice; windows that overlap, touch, repeat no event or hold none."""
    rng, rows = random.Random(7), []
    for i in range(900):
        kind = rng.choice(["checkout.error", "request.duration", "request.duration", "payment.latency", "debug.click", "deployment.completed", "rollback.completed"])
        value = rng.choice([40.0, 700.0, 2000.0]) if "." in kind and kind.split(".")[1] in ("duration", "latency") else None
        tags = {"trace_id": f"t{rng.randrange(60)}"}
        if kind.startswith(("deploy", "roll")):
            tags |= {"version": f"v{i}"} | ({"rollback_of": f"CHG-e{rng.randrange(i + 1)}"} if kind.startswith("roll") else {})
        at = T0 + timedelta(seconds=8 * (i // 3 * 3))
        rows.append((f"e{i}", rng.choice("ab"), rng.choice(["x", "y"]), kind, at, at, tags, None, value, value and "ms", "1", None, rng.choice([None, "", "c1", f"c{i // 9}"])))
    rows += rows[::13]
    spans = [(t, f"i{k}", T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + n)) for t in "ab" for k, (s, n) in enumerate([(0, 400), (296, 304), (300, 400), (1500, 360), (3599, 2), (5000, 400), (90000, 60)])]
    return spark.createDataFrame(spans, "tenant_id string, incident_id string, frozen_from timestamp, frozen_to timestamp"), spark.createDataFrame(rows, KINDS)


def _of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("few", [100_000, 0])
def test_windows_have_the_edges_of_frozen_events(spark, monkeypatch, few):
    monkeypatch.setattr(window_graph, "WINDOWS", 1)
    monkeypatch.setattr(evidence, "FEW", few)
    inc, captures = _inputs(spark)
    fz = evidence.freeze(inc, captures).localCheckpoint()
    marks = changes.change_markers(captures.dropDuplicates(["event_id"]))
    spans = fz.groupBy("tenant_id", "incident_id").agg(F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))
    near = changes.changes_near(spans, marks).localCheckpoint()
    g = window_graph.Graph(inc, window_graph.event_facts(captures), marks)
    for cap in (None, 60) if few else (None, 7):
        nodes, edges = evidence.evidence_graph(inc, fz, near, cap)
        assert _of(g.edges(cap)) == _of(edges)
        kept = edges.groupBy("tenant_id", "incident_id", "relation").agg(F.count(F.lit(1)).alias("kept"))
        assert _of(g.counts(cap).where("kept > 0").drop("n")) == _of(kept)
    assert _of(g.nodes().drop("attributes")) == _of(nodes.drop("attributes"))
    assert {r.relation for r in g.counts().collect()} == {*evidence.RELATIONS} - {*evidence.RUNS.values()}


def test_links_are_made_once_for_all_incidents(spark, monkeypatch):
    """Links of one source are as many rows as without incidents, however many windows hold them."""
    inc, captures = _inputs(spark)
    many = inc.unionByName(inc.withColumn("incident_id", F.concat("incident_id", F.lit("-again"))))
    f = window_graph.event_facts(captures)
    made = [window_graph.source_links(f, window_graph.Windows(x), lambda _: True).count() for x in (inc, many)]
    assert made[0] == made[1]


@pytest.mark.parametrize("block", [1024, 4])
@pytest.mark.parametrize("least", [0.0, 0.35, 0.7, 0.9])
def test_sets_in_blocks_have_the_links_of_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(evidence, "BLOCK", block)
    rng, rows = random.Random(3), []
    for i in range(70):
        some = lambda xs, k: rng.sample(xs, rng.randrange(k + 1))
        for family, xs, k in (("source", ["s1", "s2", "s3"], 2), ("type", ["a", "b", "c"], 2), ("hypothesis", ["h"], 1), ("change", [f"version:v{n}" for n in range(8, 14)], 2)):
            rows += [("t", f"i{i:02}", family, x) for x in some(xs, k)]
    feats = spark.createDataFrame(rows, "tenant_id string, incident_id string, family string, feature string")
    sets = evidence.feature_sets(feats).localCheckpoint()
    own = sets.select("tenant_id", "set").distinct()
    pairs = own.select("tenant_id", F.col("set").alias("left")).join(own.select("tenant_id", F.col("set").alias("right")), "tenant_id").where("left < right")
    assert _of(evidence.similar_sets(sets, least)) == _of(evidence.compare(feats, pairs).where(F.col("similarity") >= least))


def test_a_large_core_is_many_tasks(spark, monkeypatch):
    """Sets of one core met in one task; now a task gets pairs of blocks, and their number grows with the pairs."""
    monkeypatch.setattr(evidence, "BLOCK", 16)
    monkeypatch.setattr(evidence, "PAIRS", 500)
    feats = spark.range(200).selectExpr("'t' tenant_id", "concat('i', id) incident_id", "explode(array(named_struct('family', 'source', 'feature', 's'), named_struct('family', 'change', 'feature', concat('version:v', id)))) f").select("tenant_id", "incident_id", "f.*")
    links = evidence.similar_sets(evidence.feature_sets(feats))
    held = links.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in held) == 200 * 199 // 2
    assert max(r["count"] for r in held) < 200 * 199 // 8

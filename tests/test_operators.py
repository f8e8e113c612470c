"""Small scenarios with known results."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.operators import cardinality, changes, evidence, folds, lineage, replay, schemas, shaping, stats
from obsflow.operators.intervals import interval_join
from obsflow.operators.numbering import numbered
from obsflow.plans import registry, views
from obsflow.schema import EVENT, CardinalityRule, Policy, Pressure, Protection, ShapingConfig, ShapingRule
from obsflow.streaming.pipeline import KeyedSpacing, decisions_once, dedup_stream, merge_batch, parquet_sink, run_pipeline, spaced_stream, split_failures, windowed_stats, with_lateness

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """(id, seconds, type, value, tags) as canonical events of one tenant and source."""
    data = [(i, "t", "api", kind, T0 + timedelta(seconds=s), tags or {}, None, value, None if value is None else "ms", "1", None, None) for i, s, kind, value, tags in rows]
    return spark.createDataFrame(data, EVENT)


def test_drop_tag_at_threshold_two(spark):
    ev = events(spark, [("a", 0, "x", None, {"request_id": "A"}), ("b", 1, "x", None, {"request_id": "B"})])
    out, found, _ = cardinality.apply_policy(ev, Policy("p", rules=(CardinalityRule(dimension="request_id", unique_threshold=2, action="drop_tag"),)))
    assert {r.event_id: dict(r.tags) for r in out.collect()} == {"a": {"request_id": "A"}, "b": {}}
    assert [r.event_id for r in found.collect()] == ["b"]


def test_counts_of_incidents_with_and_without_events(spark):
    inc = spark.createDataFrame([("t", "full"), ("t", "none"), ("u", "full")], "tenant_id string, incident_id string")
    fz = spark.createDataFrame([("t", "full", s, e) for s, e in (("svc-0", "e1"), ("svc-2", "e2"), ("svc-1", "e3"), ("svc-1", "e3"))], "tenant_id string, incident_id string, source string, event_id string")
    got = {(r.tenant_id, r.incident_id): r.events for r in evidence.incident_counts(inc, fz).collect()}
    assert got == {("t", "full"): 3, ("t", "none"): 0, ("u", "full"): 0}


def test_graph_has_the_runs_of_its_incidents(spark):
    key = "tenant_id string, incident_id string"
    inc = spark.createDataFrame([("t", "i"), ("u", "i")], key)
    fz = events(spark, [("a", 0, "x", None, None)]).withColumn("incident_id", F.lit("i"))
    replays = spark.createDataFrame([("t", "i", "r1"), ("t", "i", "r2"), ("t", "other", "r3")], f"{key}, run_id string")
    costs = spark.createDataFrame([("t", "i", "c1"), ("v", "i", "c2")], f"{key}, run_id string")
    nodes, edges = evidence.evidence_graph(inc, fz, cap=0, replays=replays, costs=costs)
    made = {(r.tenant_id, r.id, r.kind) for r in nodes.where("kind in ('replay', 'cost-simulation')").collect()}
    assert made == {("t", "replay:r1", "replay"), ("t", "replay:r2", "replay"), ("t", "cost:c1", "cost-simulation")}
    got = {(r["from"], r.to, r.relation, r.assessment) for r in edges.where("relation like 'evaluated%'").collect()}
    assert got == {("incident:i", f"replay:r{k}", "evaluated-by-replay", "related") for k in (1, 2)} | {("incident:i", "cost:c1", "evaluated-by-cost-simulation", "related")}


def test_bundle_selects_by_pair_and_near_changes(spark):
    key = "tenant_id string, incident_id string"
    inc = spark.createDataFrame([("t", "i")], key)
    fz = events(spark, [("a", 0, "x", None, None), ("b", 60, "y", None, None)]).withColumn("incident_id", F.lit("i"))
    fz = fz.union(events(spark, [("c", 0, "z", None, None)]).withColumn("incident_id", F.lit("left out")))
    table = spark.createDataFrame([(t, "api", e, "1") for t, e in (("t", "x"), ("t", "y"), ("t", "z"), ("u", "x"))], "tenant_id string, source string, event_type string, schema_version string")
    near = [("t", f"c{s}", T0 + timedelta(seconds=s)) for s in (-901, -900, 360, 361)] + [("u", "other", T0)]
    got = lineage.bundle(inc, {"events": fz}, {"schemas": table}, spark.createDataFrame(near, "tenant_id string, change_id string, changed_at timestamp"))
    assert {r.event_id for r in got["events"].collect()} == {"a", "b"}
    assert {(r.tenant_id, r.incident_id, r.event_type) for r in got["schemas"].collect()} == {("t", "i", "x"), ("t", "i", "y")}
    assert {(r.incident_id, r.change_id) for r in got["changes"].collect()} == {("i", "c-900"), ("i", "c360")}


def test_whole_queries_cover_all_events(spark):
    q, small = registry.QUERIES, "/root/testdata/sf0.001"
    all_ = views.events(spark, small)
    assert q["s6_changes_to_events_all"](spark, small).count() == all_.count()
    assert {r.n % 4 for r in q["s7_counter_delta_all"](spark, small).collect()} == {0, 1, 2, 3}
    frozen = {(r.tenant_id, r.incident_id): r.events for r in q["j1_freeze"](spark, small).collect()}
    got = {(r.tenant_id, r.incident_id): r.events for r in q["j2_incident_counts_all"](spark, small).collect()}
    assert got == frozen and sum(got.values()) > 0
    spark.catalog.clearCache()


def test_pressure_has_a_floor(spark):
    cfg = ShapingConfig("c", pressure=Pressure(True, 0.7, 0.9, 0.5, 0.2), rules=(ShapingRule("r", sample_rate=0.5, min_sample_rate=0.1),))
    row = shaping.shape(events(spark, [("a", 0, "x", None, None)]), cfg, 0.95).collect()[0]
    assert row.decision.effective_rate == 0.1


def test_protected_slow_event_is_untouched(spark):
    cfg = ShapingConfig("c", default_sample_rate=0.0, protection=Protection(latency_threshold_ms=1000), rules=(ShapingRule("r", drop_tags=("k",), payload_max_bytes=1, payload_action="drop"),))
    row = shaping.shape(events(spark, [("a", 0, "latency", 1500.0, {"k": "v"})]), cfg).collect()[0]
    assert row.decision.keep and dict(row.new_tags) == {"k": "v"} and not row.decision.payload_dropped


def test_evidence_sequence(spark):
    ev = events(spark, [("d", 0, "deployment.completed", None, None), ("s", 10, "latency", 1500.0, None), ("e", 20, "error", None, None), ("n", 50, "latency", 100.0, None)]).withColumn("incident_id", F.lit("i"))
    inc = spark.createDataFrame([("t", "i")], "tenant_id string, incident_id string")
    nodes, edges = evidence.evidence_graph(inc, ev)
    found = {(r.relation, r.assessment) for r in edges.collect()}
    assert {("change-precedes-error", "supporting"), ("recovery-signal", "contradicting"), ("latency-precedes-error", "supporting")} <= found
    assert nodes.count() == 5


def test_structured_rollback(spark):
    ev = events(spark, [("s", 120, "latency", 1500.0, None), ("e", 180, "error", None, None), ("n", 480, "latency", 100.0, None)]).withColumn("incident_id", F.lit("i"))
    inc = spark.createDataFrame([("t", "i")], "tenant_id string, incident_id string")
    marks = events(spark, [("c", 0, "deployment.completed", None, {"change_id": "C1"}), ("r", 360, "rollback.completed", None, {"change_id": "C2", "rollback_of": "C1"})])
    _, edges = evidence.evidence_graph(inc, ev, changes.change_markers(marks).withColumn("incident_id", F.lit("i")))
    assert {"change-near-incident", "structured-change-precedes-error", "explicit-rollback-of", "recovery-after-rollback"} <= {r.relation for r in edges.collect()}


def test_deployment_regression(spark):
    rows = [(f"b{i}", -60 * (i + 1), "latency", 180.0, None) for i in range(12)] + [(f"a{i}", 30 * (i + 1), "latency error" if i % 2 else "latency", 1500.0, None) for i in range(12)]
    marks = events(spark, [("c", 0, "deployment.completed", None, None), ("r", 960, "rollback.completed", None, {"rollback_of": "CHG-c"})])
    out = {r.change_id: r for r in changes.analyze_changes(changes.change_markers(marks), events(spark, rows)).collect()}
    assert out["CHG-c"].overall == "regression-associated" and out["CHG-c"].blast_radius_percent > 0 and out["CHG-c"].rollback_id == "CHG-r"


def test_greedy_spacing_equals_a_walk(spark):
    rng = random.Random(4)
    rows = [(f"{i:03}", rng.randrange(3000), rng.choice("xy"), None, None) for i in range(300)]
    expected = set()
    for kind in "xy":
        last = None
        for s, i in sorted((r[1], r[0]) for r in rows if r[2] == kind):
            if last is None or s - last >= 60:
                expected.add(i)
                last = s
    got = folds.spaced(events(spark, rows), ["tenant_id", "event_type"], "event_time", "event_id", 60)
    assert {r.event_id for r in got.collect()} == expected


def test_running_estimate_equals_registers(spark):
    import hashlib
    import math

    rows = [(f"{i:04}", i, "x", None, {"d": f"v{i * 7 % 300}"}) for i in range(900)]
    got = {r.event_id: r.sketched for r in cardinality.running_hll(cardinality.tag_rows(events(spark, rows)), cardinality.KEY).collect()}
    regs = [0] * 64
    for i, _, _, _, tags in rows:
        h = int.from_bytes(hashlib.sha256(tags["d"].encode()).digest()[:8], "big")
        rest, rank = h >> 6, 1
        while rank < 59 and not rest & 1:
            rank, rest = rank + 1, rest >> 1
        regs[h & 63] = max(regs[h & 63], rank)
        raw, zeros = 0.709 * 4096 / sum(2.0**-r for r in regs), regs.count(0)
        raw = 64 * math.log(64 / zeros) if raw <= 160 and zeros else raw
        assert got[i] == max(1, round(raw))


def test_trackers_agree(spark):
    rows = cardinality.tag_rows(events(spark, [(f"e{i}", i, "x", None, {"user_id": str(i % 300), "k": str(i % 7)}) for i in range(900)]))
    of = lambda name: {r.dimension: (r.observed, r.samples) for r in cardinality.cardinality_hourly(rows, tracker=name).collect()}
    assert of("exact") == {"user_id": (300, 900), "k": (7, 900)}
    assert of("registers")["k"] == (7, 900) and abs(of("registers")["user_id"][0] - 300) < 120
    assert of("sketch")["k"] == (7, 900) and abs(of("sketch")["user_id"][0] - 300) < 20


def test_slices_of_a_hot_hour_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"e{i:04d}", rng.randrange(0, 40), "x" if i % 4 else "y", None, {"user_id": str(rng.randrange(60)), "k": str(i % 7)}) for i in range(600)]
    policy = Policy("p", "1", 12, "drop_tag", ("user_id",))
    ask = lambda: sorted(tuple(r) for r in cardinality.decisions(events(spark, rows), policy).select("event_id", "dimension", "observed", "projected", "act", "reason").fillna("").collect())
    counts = lambda: sorted(tuple(r) for r in cardinality.running(events(spark, rows)).select("event_id", "dimension", "exact", "sketched").collect())
    plain, running = ask(), counts()
    monkeypatch.setattr(cardinality, "HOT", 200)
    assert counts() == running and len(running) == 1200
    assert ask() == plain and len({r[2] for r in plain}) > 20


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), i, rng.randrange(5000), rng.randrange(900)) for i in range(60)]
    points = [(rng.choice("ab"), i, rng.randrange(5000)) for i in range(200)]
    left = spark.createDataFrame(spans, "k string, s int, a long, n long").select("k", "s", F.timestamp_seconds("a").alias("x"), F.timestamp_seconds(F.col("a") + F.col("n")).alias("y"))
    right = spark.createDataFrame(points, "k string, p int, t long").select("k", "p", F.timestamp_seconds("t").alias("t"))
    got = {(r.s, r.p) for r in interval_join(left, right, ["k"], F.col("x"), F.col("y"), F.col("t"), 300).collect()}
    assert got == {(s, p) for k, s, a, n in spans for q, p, t in points if k == q and a <= t <= a + n}


def test_merkle_root_and_odd_leaves(spark):
    import hashlib

    def root(leaves):
        while len(leaves) > 1:
            leaves = [hashlib.sha256(a + b).digest() for a, b in zip(leaves[::2], [*leaves[1::2], leaves[-1]], strict=False)]
        return leaves[0].hex()

    data = [(g, i, hashlib.sha256(f"{g}{i}".encode()).hexdigest()) for g in range(1, 8) for i in range(g)]
    got = lineage.merkle_root(spark.createDataFrame(data, "g int, i int, leaf string"), ["g"], ["i"], "leaf")
    assert {r.g: r.root for r in got.collect()} == {g: root([bytes.fromhex(x) for h, _, x in data if h == g]) for g in range(1, 8)}


def test_globs(spark):
    row = spark.createDataFrame([("svc-a/b",)], "c string").select(*(X.glob(p, F.col("c")).alias(f"g{i}") for i, p in enumerate(("*", "svc-*", "svc-?/b", "svc-[ab]/*", "svc-a\\/b")))).collect()[0]
    assert list(row) == [True, False, True, True, True]


def test_empty_tables(spark):
    none = events(spark, [])
    assert stats.summary(none, "2024-01-01", 60).count() == 0
    assert evidence.detect_incidents(none).count() == 0
    assert changes.analyze_changes(changes.change_markers(none), none).count() == 0
    assert cardinality.apply_policy(none, Policy("p"))[0].count() == 0


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(f"{i}", i, "error" if i % 3 == 0 else "ok", None, None) for i in range(30)]
    events(spark, rows + rows[:5]).write.parquet(str(source))
    stream = spark.readStream.schema(EVENT).parquet(str(source))
    query = run_pipeline(dedup_stream(stream), lambda df: df.where("event_type = 'error'"), {"out": parquet_sink(str(out))}, str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 10
    q = windowed_stats(stream, "10 seconds").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start.second, r.errors) for r in spark.table("w").collect()} == {(0, 6), (10, 3), (20, 3)}


def test_keyed_spacing_state():
    import pandas as pd

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    state = KeyedSpacing(60)
    state.last = Value()
    frame = lambda *s: pd.DataFrame({"event_time": pd.to_datetime(list(s), unit="s")})
    assert len(next(state.handleInputRows(("k",), iter([frame(0, 30, 60)]), None))) == 2
    assert len(next(state.handleInputRows(("k",), iter([frame(100, 125)]), None))) == 1


def test_one_decimal_is_exact(spark):
    values = [1374.05, 0.25, 0.75, 0.05, 0.15, 1000.0, 2.675, 1e12 + 0.25, 1e14 + 0.75, 999.95, 0.0, 123456.65] + [random.Random(i).uniform(0, 5000) for i in range(200)] + [i / 8 for i in range(100)] + [i / 20 for i in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.one_decimal(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{r.v:.1f}" for r in rows]
    assert [X.duration_text(s) for s in (45, 60, 90, 3600, 7205)] == ["45s", "1m0s", "1m30s", "1h0m0s", "2h0m5s"]


def test_rows_are_numbered_over_bins(spark):
    rng = random.Random(4)
    rows = [("k" if i % 3 else None, T0 + timedelta(seconds=rng.randrange(20_000)), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, at timestamp, id long"), ["k"], "at", "id", "no", 600).collect()
    want = {}
    for k in ("k", None):
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1)}
    assert {r.id: r.no for r in got} == want


def test_endless_island_equals_a_walk(spark, monkeypatch):
    monkeypatch.setattr(folds, "FOLDED", 50)
    monkeypatch.setattr(folds, "PIECE", 8)
    rng = random.Random(9)
    at = lambda t: T0 + timedelta(milliseconds=t)
    rows, t = [], 0
    for i in range(4000):
        t += rng.choice((0, 1, 300, 900, 9_000, 40_000))
        rows.append(("a", at(t), f"e{i:05d}"))
    rows += [("b", at(1000 * s), f"f{s}") for s in (0, 30, 60, 200)]
    got = {r.id for r in folds.spaced(spark.createDataFrame(rows, "k string, at timestamp, id string"), ["k"], "at", "id", 60).collect()}
    want, last = set(), {}
    for k, when, i in sorted(rows):
        if k not in last or (when - last[k]).total_seconds() >= 60:
            want.add(i)
            last[k] = when
    assert got == want and len(want) > 100


def test_steady_source_of_many_errors(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 500_000).alias("at"), F.col("id").cast("string").alias("id"))
    assert folds.spaced(rows, ["k"], "at", "id", 60).count() == -(-200_000 // 120)


def test_schema_bounds(spark):
    import json

    rows = events(spark, [("none", 0, "x", None, {}), ("tags", 1, "x", 2.0, {f"k{i:03d}": "v" for i in range(600)}), ("wide", 2, "x", None, {"a": "b"}), ("deep", 3, "x", None, {}), ("bad", 4, "x", None, {}), ("list", 5, "x", None, {})])
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}
    body = {"wide": json.dumps({f"p{i:03d}": i for i in range(600)}), "deep": json.dumps(deep), "bad": "{oops", "list": '{"z": [1, {"q": 2}], "y": null, "b.c": {"d": true}}'}
    payload = F.lit(None).cast("string")
    for k, v in body.items():
        payload = F.when(F.col("event_id") == k, F.lit(v)).otherwise(payload)
    got = {r.event_id: r for r in schemas.describe(rows.withColumn("payload", payload)).collect()}
    paths = lambda k: [(f.path, f.type) for f in got[k].fields]
    assert paths("none") == [] and not got["none"].truncated
    assert len(paths("tags")) == 512 and ("metric.value", "number") in paths("tags") and ("tags.k509", "string") in paths("tags") and ("tags.k510", "string") not in paths("tags") and got["tags"].truncated
    assert len(paths("wide")) == 512 and ("payload.p509", "number") in paths("wide") and ("payload.p510", "number") not in paths("wide") and got["wide"].truncated
    assert paths("deep") == [("payload", "object"), ("payload.a", "object"), ("payload.a.b", "object"), ("payload.a.b.c", "object"), ("payload.a.b.c.d", "object"), ("payload.a.b.c.d.e", "object")] and got["deep"].truncated
    assert paths("bad") == [("payload", "string")] and not got["bad"].truncated
    assert paths("list") == [("payload", "object"), ("payload.b.c", "object"), ("payload.b.c.d", "boolean"), ("payload.y", "null"), ("payload.z", "array")]


def test_rendezvous_eligibility(spark):
    nodes = [("n1", "c1", "r1", "z1"), ("n2", "c1", "r1", "z2"), ("n3", "c1", "r2", "z9"), ("n4", "c2", "r9", "z9")]
    keys = spark.range(200).select(F.col("id").cast("string").alias("key"))
    of = lambda **more: {r.node for r in lineage.rendezvous(keys, nodes, ("c1", "r1", "z1"), **more).collect()}
    assert of() == {"n1"}
    assert of(states={"n1": {"draining": True}}) == {"n2"}
    assert of(states={"n1": {"ready": False}, "n2": {"pressure": 0.99}}) == {"n3"}
    assert of(states={n: {"age": 60.0} for n in ("n1", "n2", "n3")}) == {"n4"}
    assert of(states={n: {"age": 60.0} for n in ("n1", "n2", "n3", "n4")}) == {None}
    assert of(states={"n1": {"age": 60.0, "local": True}}) == {"n1"}
    assert of(policy="any") == {"n1", "n2", "n3", "n4"}


def test_compare_of_given_pairs(spark):
    feats = [("t", i, f, x) for i, own in (("a", "pq"), ("b", "pq"), ("c", "qr"), ("d", "z")) for f, x in (("source", own[0]), ("type", own[-1]))]
    df = spark.createDataFrame(feats, "tenant_id string, incident_id string, family string, feature string")
    sets = evidence.feature_sets(df)
    assert {r.incident_id: r.set for r in sets.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert evidence.similar_sets(sets).count() == 0
    asked = spark.createDataFrame([("t", "b", "a"), ("t", "a", "d")], "tenant_id string, left string, right string")
    assert {(r.left, r.right): r.similarity for r in evidence.compare(df, asked).collect()} == {("b", "a"): 0.55}


def test_replay_normalizes_first(spark):
    ev = events(spark, [("a", 0, " x ", None, {"user_id": "1"}), ("b", 1, "x", None, {"user_id": "2"})]).withColumn("incident_id", F.lit("i"))
    policy = Policy("p", rules=(CardinalityRule(type="x", dimension="user_id", unique_threshold=2, action="quarantine"),))
    assert {r.event_id: r.quarantined for r in replay.replay(ev, policy).collect()} == {"a": False, "b": True}


def test_stream_restarts_write_each_batch_once(spark, tmp_path):
    """Validation, deduplication against a store and decisions, over two runs of one stream."""
    source, out, store = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "store")
    events(spark, []).write.parquet(store)

    def step(batch):
        ok, _ = split_failures(batch)
        return decisions_once(ok, spark.read.schema(EVENT).parquet(store))

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        run_pipeline(stream, step, {"out": parquet_sink(out)}, str(tmp_path / "checkpoint")).awaitTermination()

    events(spark, [("a", 0, "x", None, {}), ("b", 1, "", None, {}), ("a", 0, "x", None, {})]).coalesce(1).write.mode("append").parquet(source)
    run()
    first = sorted(r.event_id for r in spark.read.parquet(out).collect())
    events(spark, [("c", 2, "y", None, {})]).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert first == ["a"] and sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["a", "c"]


def test_late_events_and_merged_state(spark):
    ev = events(spark, [("a", 0, "x", None, {}), ("b", 900, "x", None, {})])
    on_time, late = with_lateness(ev, T0 + timedelta(seconds=900), 600)
    assert [r.event_id for r in on_time.collect()] == ["b"] and [r.event_id for r in late.collect()] == ["a"]
    state = spark.createDataFrame([("k", 1, "old", 5)], "k string, at long, status string, total long")
    batch = spark.createDataFrame([("k", 2, "new", 1), ("l", 1, "l", 1)], "k string, at long, status string, total long")
    got = {r.k: (r.status, r.total) for r in merge_batch(batch, state, ["k"], "at", {"status": "last", "total": "add"}).collect()}
    assert got == {"k": ("new", 6), "l": ("l", 1)}


def test_spacing_goes_on_after_a_restart(spark, tmp_path):
    """Keyed state of a real stream: what a first run let through holds in the second."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "tenant_id string, source string, event_id string, event_time timestamp"

    def run(rows):
        spark.createDataFrame([("t", s, i, T0 + timedelta(seconds=at)) for s, i, at in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spaced_stream(spark.readStream.schema(schema).parquet(source), ["tenant_id", "source"], 60)
        run_pipeline(stream, lambda df: df, {"out": parquet_sink(out)}, str(tmp_path / "checkpoint"), once=True).awaitTermination()  # processing-time timeouts keep other triggers going
        return sorted(r.event_id for r in spark.read.parquet(out).collect())

    assert run([("a", "a0", 0), ("a", "a30", 30), ("a", "a60", 60), ("b", "b0", 0)]) == ["a0", "a60", "b0"]
    assert run([("a", "a100", 100), ("a", "a125", 125), ("b", "b59", 59)]) == ["a0", "a125", "a60", "b0"]

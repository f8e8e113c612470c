"""Selection of percentiles, drift states, slices of time, similarity and graph links: brute force and large keys."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from obsflow.operators import quantiles, schemas

T0 = dt.datetime(2024, 1, 1)


def percentile(values, q):
    values = sorted(values)
    place = (len(values) - 1) * q
    low, high = math.floor(place), math.ceil(place)
    return values[low] if values[low] == values[high] else (high - place) * values[low] + (place - low) * values[high]


@pytest.mark.parametrize("q", [0.0, 0.95])
def test_selected_percentiles_equal_sorted_ones(spark, q):
    rng = random.Random(5)
    groups = {
        "even": [rng.random() for _ in range(5000)], "ties": [float(rng.randrange(3)) for _ in range(3000)], "tail": [10 ** rng.uniform(-300, 300) for _ in range(4000)],
        "near": [1.0 + rng.randrange(5000) * 2.0**-52 for _ in range(3000)], "one": [7.5], "two": [1.0, 2.0], "wide": [-1.7e308, 1.7e308, 0.0] * 50,
        "signs": [rng.uniform(-1, 1) for _ in range(2000)], "ends": [float("-inf")] * 10 + [1.0] * 5 + [float("inf")] * 300, None: [float(i) for i in range(2500)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("even", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in quantiles.aggregate(df, ["k"], [F.count(F.lit(1)).alias("n")], {"p": F.col("v"), "up": F.when(F.col("v") > 0, F.col("v"))}, q, buffered=40).collect()}
    assert got["none"].p is None and got["even"].n == 5001 and set(got) == {*groups, "none"}
    for k, vs in groups.items():
        assert got[k].p == percentile(vs, q), k
        up = [v for v in vs if v > 0]
        assert got[k].up == (percentile(up, q) if up else None), k


def test_a_hot_group_is_never_one_task(spark, monkeypatch):
    # One tenant holds nearly all of a million values: what is gathered in the end is less than the bound.
    df = spark.range(0, 1_000_000, numPartitions=8).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    left, within = [], quantiles._within
    monkeypatch.setattr(quantiles, "_within", lambda *a: left.append(within(*a)) or left[-1])
    got = {r.k: r.p for r in quantiles.aggregate(df, ["k"], [], {"p": F.col("v")}, buffered=2_000).collect()}
    assert got == {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", 0.95).alias("p")).collect()}
    assert 0 < left[-1].groupBy("_group", "_which").count().agg(F.max("count")).first()[0] <= 2_000


def described(spark, rows):
    fields = [(f"e{i:05d}", T0 + dt.timedelta(seconds=s), "t", source, "x", version, url, [(p, k) for p, k in sorted(fs.items())]) for i, (s, source, version, url, fs) in enumerate(rows)]
    return spark.createDataFrame(fields, "event_id string, event_time timestamp, tenant_id string, source string, event_type string, schema_version string, schema_url string, fields array<struct<path:string,type:string>>")


@pytest.mark.parametrize("seed", range(3))
def test_drift_from_states_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    share = {"a": 1.0, "b": 0.99, "c": 0.96, "d": 0.5, "e": 0.02, "late": 1.0}
    rows = []
    for i in range(900):
        s = rng.choice([0, 0, 60, 300, 4000, 9000, 20_000]) + (i // 60) * 7200
        fs = {p: "number" if rng.random() < 0.9 else "string" for p, q in share.items() if rng.random() < q and (p != "late" or i > 400) and not (p == "c" and 500 < i < 540)}
        rows.append((s, rng.choice(["s", "s", "s", "r"]), rng.choice(["1", "1", "2"]), rng.choice([None, "u1", "u1", "u2"]), fs))
    df = described(spark, rows)
    versions = {}
    for i, (s, source, version, url, fs) in enumerate(rows):
        versions.setdefault((source, version), []).append((s, f"e{i:05d}", url, fs))
    added, conflicts, missing, urls, previous = [], [], [], [], []
    for (source, version), obs in versions.items():
        obs.sort(key=lambda o: o[:2])
        first, seen, lost, last = {}, {}, {}, None
        for n, (_, e, url, fs) in enumerate(obs, 1):
            for p in {p for o in obs for p in o[3]}:
                if p in fs:
                    continue
                if n - 1 >= 20 and seen.get(p, 0) * 100 >= (n - 1) * 95:
                    k = lost.get(p, (0, 0))[0]
                    lost[p] = (k + 1, n)
            for p, kind in fs.items():
                if p not in first:
                    first[p] = kind
                    if n > 1:
                        added.append((source, version, p, kind, n))
                elif kind != first[p]:
                    conflicts.append((source, version, p, first[p], kind, n))
                seen[p] = seen.get(p, 0) + 1
            if url is not None:
                if last is not None and url != last:
                    urls.append((source, version, e, last, url))
                last = url
        missing += [(source, version, p, k, n) for p, (k, n) in lost.items()]
        before = [(s, f"e{i:05d}", v) for i, (s, src, v, *_ ) in enumerate(rows) if src == source and (s, f"e{i:05d}") < obs[0][:2]]
        previous.append((source, version, max(before)[2] if before else None))
    key = ["source", "schema_version"]
    of = lambda found, *cols: sorted(map(str, (tuple(r) for r in found.select(*key, *cols).collect())))
    assert of(schemas.fields_added(df), "path", "type", "obs_no") == sorted(map(str, added))
    assert of(schemas.type_conflicts(df), "path", "previous_type", "type", "obs_no") == sorted(map(str, conflicts))
    assert of(schemas.required_missing(df), "path", "occurrences", "last_obs") == sorted(map(str, missing)) and missing
    assert of(schemas.schema_url_changes(df), "event_id", "previous_url", "schema_url") == sorted(map(str, urls))
    assert of(schemas.previous_version(df), "previous") == sorted(map(str, previous))
    drifts = {(r.source, r.schema_version, r.kind, r.path, r.type): r.occurrences for r in schemas.schema_drifts(df).collect()}
    assert sum(drifts.values()) == len(added) + len(conflicts) + sum(m[3] for m in missing)


def test_slices_equal_plain_windows(spark):
    from obsflow.functions import exprs as X
    from obsflow.operators import folds, stats
    from pyspark.sql import Window as W

    rng = random.Random(8)
    # One source errs four times a second for fourteen hours: one endless island; another in bursts.
    rows = [("t", "hot", i // 4 + i % 4 * 0.25) for i in range(200_000)] + [("t", "calm", rng.randrange(40) * 5000 + rng.randrange(90)) for _ in range(3000)]
    df = spark.createDataFrame([(t, s, float(at), f"e{i}") for i, (t, s, at) in enumerate(rows)], "tenant_id string, source string, at double, event_id string")
    df = df.select("*", F.timestamp_seconds(F.col("at") + 1704067200).alias("event_time"), F.lit("x.error").alias("event_type"), F.lit(None).cast("double").alias("metric_value"), F.lit("ms").alias("metric_unit"), F.create_map(F.lit("k"), F.lit("v")).alias("tags"))
    w = W.partitionBy("tenant_id", "source").orderBy(F.unix_micros("event_time")).rangeBetween(-(60_000_000 - 1), 0)
    plain = df.withColumn("recent_errors", F.count(F.when(X.is_error(), 1)).over(w)).select("event_id", "recent_errors")
    assert stats.sliding_error_count(df).select("event_id", "recent_errors").exceptAll(plain).count() == 0
    per_task = stats.sliding_error_count(df).where("source = 'hot'").groupBy(F.floor(F.unix_micros("event_time") / 960_000_000)).count().agg(F.max("count")).first()[0]
    assert per_task <= 4 * 960
    islands = folds._islands(df, ["tenant_id", "source"], "event_time", "event_id", 60_000_000)
    us, order = F.unix_micros("event_time"), W.partitionBy("tenant_id", "source").orderBy("event_time", "event_id")
    want = df.withColumn("gap", F.coalesce(us - F.lag(us).over(order) >= 60_000_000, F.lit(True)).cast("int"))
    want = want.select("event_id", F.sum("gap").over(order).alias("_island"), F.row_number().over(order).alias("_nth"))
    assert islands.select("event_id", "_island", "_nth").exceptAll(want).count() == 0
    kept = {}
    for r in sorted(df.select("source", "at", "event_id").collect(), key=lambda r: (r.source, r.at, r.event_id)):
        if r.source not in kept or r.at - kept[r.source][-1][0] >= 60:
            kept.setdefault(r.source, []).append((r.at, r.event_id))
    got = folds.throttle(df.select("tenant_id", "source", "event_time", "event_id"), ["tenant_id", "source"]).collect()
    assert sorted(r.event_id for r in got) == sorted(e for ks in kept.values() for _, e in ks)


def test_sketches_count_no_null_values(spark):
    """A null is no value: it neither fills a register nor hides one beyond the exact ones."""
    from obsflow.operators import cardinality as K

    rows = [("a", None), ("b", None), *(("b", str(i)) for i in range(K.EXACT + 1)), ("c", "x"), ("c", "x"), ("c", None)]
    state = K.sketch(spark.createDataFrame(rows, "k string, value string"), ["k"])
    for states in (state, K.merge_sketches(state.union(state), ["k"])):
        got = {r.k: (len(r.registers), any(r.registers), len(r.hashes), r.overflow) for r in states.collect()}
        assert got == {"a": (K.REGISTERS, False, 0, False), "b": (K.REGISTERS, True, 0, True), "c": (K.REGISTERS, True, 1, False)}


def test_sketches_are_small_and_merge_in_any_order(spark):
    from obsflow.operators import cardinality as K

    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "many").when(F.col("id") < 5900, "few").otherwise("one").alias("k"), F.when(F.col("id") < 5000, F.col("id")).when(F.col("id") < 5900, F.col("id") % 16).otherwise(7).cast("string").alias("value"), (F.col("id") % 3).alias("part"))
    parts = [K.sketch(rows.where(F.col("part") == i), ["k"]) for i in range(3)]
    whole = sorted(map(tuple, K.sketch(rows, ["k"]).collect()))
    a, b, c = parts
    for merged in (K.merge_sketches(a.union(b).union(c), ["k"]), K.merge_sketches(K.merge_sketches(c.union(a), ["k"]).union(b), ["k"]), K.merge_sketches(b.union(b).union(K.merge_sketches(a.union(c), ["k"])), ["k"])):
        assert sorted(map(tuple, merged.collect())) == whole
    assert [(k, len(r), len(h), over) for k, r, h, over in whole] == [("few", 64, 16, False), ("many", 64, 0, True), ("one", 64, 1, False)]
    got = {r.k: r.observed for r in K.sketched(K.merge_sketches(a.union(b).union(c), ["k"]), ["k"]).collect()}
    assert got["few"] == 16 and got["one"] == 1 and abs(got["many"] - 5000) < 1500


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("least", [0.0, 0.05, 0.4, 0.7])
def test_similar_sets_equal_all_pairs(spark, least):
    from obsflow.operators import evidence as E

    rng = random.Random(2)
    own = {}
    for i in range(60):
        t = "t" if i % 5 else "u"
        own[t, f"i{i:02d}"] = {f: frozenset(rng.sample(words, rng.randrange(0, 4))) for f, words in (("source", "abcd"), ("type", "efghij"), ("hypothesis", "klm"), ("change", [f"v{n}" for n in range(30)]))}
    own["t", "j0"] = own["t", "i01"]
    own = {k: v for k, v in own.items() if any(v.values())}
    feats = spark.createDataFrame([(t, i, f, x) for (t, i), fs in own.items() for f, xs in fs.items() for x in xs], "tenant_id string, incident_id string, family string, feature string")
    sets = E.feature_sets(feats)
    first = {}
    for (t, i), fs in sorted(own.items()):
        first.setdefault((t, tuple(sorted(fs.items()))), i)
    assert {(r.tenant_id, r.incident_id): r.set for r in sets.collect()} == {(t, i): first[t, tuple(sorted(fs.items()))] for (t, i), fs in own.items()}
    want = {}
    for t, a in ((t, a) for (t, a) in own if first[t, tuple(sorted(own[t, a].items()))] == a):
        for b in (b for (u, b) in own if u == t and a < b and first[t, tuple(sorted(own[t, b].items()))] == b):
            v = round(round(sum(w * jaccard(own[t, a][f], own[t, b][f]) for f, w in E.WEIGHTS.items()), 9) + 1e-12, 3)
            if v > 0 and v >= least:
                want[t, a, b] = v
    got = {(r.tenant_id, r.left, r.right): r.similarity for r in E.similar_sets(sets, least).collect()}
    assert got == pytest.approx(want) and got


def test_a_dense_incident_keeps_its_change_hypothesis(spark):
    from obsflow.operators import evidence as E

    rows = [(f"e{i:05d}", T0 + dt.timedelta(seconds=i / 5), "s", "request", "c", {}) for i in range(3100)]
    rows += [("d", T0 + dt.timedelta(seconds=1.05), "s", "deploy", None, {"version": "v1"}), ("x", T0 + dt.timedelta(seconds=9.05), "s", "x.error", None, {})]
    ev = spark.createDataFrame(rows, "event_id string, event_time timestamp, source string, event_type string, correlation_id string, tags map<string,string>")
    ev = ev.select(F.lit("t").alias("tenant_id"), F.lit("i").alias("incident_id"), "*", F.lit(None).cast("double").alias("metric_value"), F.lit(None).cast("string").alias("metric_unit"), F.lit("{}").alias("payload"))
    inc = spark.createDataFrame([("t", "i")], "tenant_id string, incident_id string")
    nodes, edges = E.evidence_graph(inc, ev, cap=2000)
    assert edges.where("relation != 'captured-in'").count() == 2000 and edges.where("relation = 'change-precedes-error'").count() == 0
    nodes, edges = E.evidence_graph(inc, ev, cap=None)
    assert "recent-change-associated" in {r.hypothesis for r in E.hypotheses(nodes, edges).collect()}
    assert {r.finding: r.support for r in E.investigate(edges).collect()} == {"recent-change-associated": 1}
    assert edges.where("relation = 'shared-correlation'").count() == 3099 and edges.where("reason is null or assessment is null").count() == 0
    row = nodes.where("id = 'event:d'").first()
    assert (row.kind, row.label, dict(row.attributes), row.event_time) == ("change", "s · deploy", {"version": "v1"}, rows[-2][1])


def test_of_repeated_captures_the_earliest_in_the_window_is_frozen(spark):
    from obsflow.operators import evidence as E

    at = lambda s: T0 + dt.timedelta(seconds=s)
    inc = spark.createDataFrame([("t", "i", at(0), at(100)), ("t", "j", at(50), at(200)), ("u", "k", at(0), at(100))], "tenant_id string, incident_id string, frozen_from timestamp, frozen_to timestamp")
    caps = spark.createDataFrame([("t", "a", at(s), s) for s in (-10, 20, 20, 60, 150, 300)] + [("t", "b", at(100), 100), ("u", "a", at(60), 60)], "tenant_id string, event_id string, captured_at timestamp, s long")
    got = {(r.incident_id, r.event_id): r.s for r in E.freeze(inc, caps).collect()}
    assert got == {("i", "a"): 20, ("i", "b"): 100, ("j", "a"): 60, ("j", "b"): 100, ("k", "a"): 60} and E.freeze(inc, caps).count() == 5


def test_merkle_roots_over_many_subtrees(spark):
    import hashlib

    from obsflow.operators import lineage

    sizes = {"one": 1, "two": 2, "odd": 7, "full": 4096, "next": 4097, "many": 9001}
    rows = [(g, i, hashlib.sha256(f"{g}{i}".encode()).hexdigest()) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    got = {r.g: r.root for r in lineage.merkle_root(spark.createDataFrame(rows, "g string, i int, leaf string"), ["g"], ["i"], "leaf").collect()}
    for g, n in sizes.items():
        nodes = [hashlib.sha256(f"{g}{i}".encode()).digest() for i in range(n)]
        while len(nodes) > 1:
            nodes = [hashlib.sha256(nodes[i] + nodes[min(i + 1, len(nodes) - 1)]).digest() for i in range(0, len(nodes), 2)]
        assert got[g] == nodes[0].hex(), g


def test_streamed_incidents_equal_the_batch_after_a_restart(spark, tmp_path):
    from obsflow.operators import evidence as E
    from obsflow.streaming.detect import detect_stream

    rng = random.Random(4)
    schema = "event_id string, tenant_id string, source string, event_time timestamp, event_type string, tags map<string,string>, metric_value double, metric_unit string"
    rows = []
    for i in range(1500):
        at = T0 + dt.timedelta(seconds=rng.choice([i * 4, i * 4, i // 50 * 200]), milliseconds=rng.choice([0, 250]))
        slow = rng.random() < 0.02
        rows.append((f"e{i:04d}", "t", rng.choice("ab"), at, "request.latency" if slow else rng.choice(["x.error", "x"]), {}, 1500.5 if slow else None, "ms" if slow else None))
    end = [(f"end{s}", "t", s, T0 + dt.timedelta(days=2), "x.error", {}, None, None) for s in "abz"]
    source, out, conf = str(tmp_path / "in"), str(tmp_path / "out"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # Events arrive out of order, up to 40 seconds late, in three runs of one query.
        order = sorted(rows, key=lambda r: (r[3] + dt.timedelta(seconds=rng.uniform(0, 40)), r[0]))
        for part in (order[:500], order[500:1100], order[1100:], end):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = detect_stream(spark.readStream.schema(schema).parquet(source), delay="5 minutes")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, E.detect_incidents(spark.createDataFrame(rows, schema)).collect()))
    assert got == want and len({r[4] for r in want}) == 2

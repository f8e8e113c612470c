"""Stores that grow by batches, the deduplication ledger and ordered topics."""

import collections
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
EVENT = "tenant_id string, event_id string, event_time timestamp, n int"


def scan_metric(df, name):
    """A metric of the scan of a plan without a shuffle, after it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply(name).value()


def test_ledger_equals_the_anti_join_and_reads_few_files(spark, tmp_path):
    from obsflow.operators import tables
    from obsflow.streaming.ledger import Ledger

    rng = random.Random(3)
    ledger = Ledger(str(tmp_path / "ledger"), buckets=16, blocks=64)
    stored = []
    for day in range(6):
        rows = [("hot" if i % 3 == 0 else f"t{i % 5}", f"e{day}-{i}", T0 + dt.timedelta(days=day, seconds=i), i) for i in range(1500)]
        df = spark.createDataFrame(rows, EVENT)
        ledger.record(ledger.fresh(df, day), day)
        stored += rows
    # Three repeats with other times, new events twice, and events without an id or a time.
    rows = [(t, e, T0 + dt.timedelta(days=9), 0) for t, e, _, _ in rng.sample(stored, 3)] + [("t1", f"new{i % 40}", T0 + dt.timedelta(days=9, seconds=i), i) for i in range(80)]
    rows += [("t1", None, T0, 1), (None, "e0-1", T0, 2), ("t2", "odd", None, 3)]
    batch = spark.createDataFrame(rows, EVENT)
    want = sorted(map(str, tables.append_dedup(batch, spark.createDataFrame(stored, EVENT)).collect()))
    assert sorted(map(str, ledger.fresh(batch, 6).collect())) == want and len(want) == 43
    possible = ledger.possible(batch, 6)
    files = scan_metric(possible, "numFiles")
    assert 3 >= files >= 1 and ledger.keys.read(spark, 6).select(F.input_file_name()).distinct().count() == 6 * 16
    assert "PartitionFilters: [" in possible._jdf.queryExecution().toString() and "PartitionFilters: []" not in possible._jdf.queryExecution().toString()
    # The same batch again: what it recorded itself doesn't count.
    ledger.record(ledger.fresh(batch, 6), 6)
    assert sorted(map(str, ledger.fresh(batch, 6).collect())) == want
    left = sorted(map(str, ledger.fresh(batch, 7).collect()))
    assert len(left) == 2 and all("None" in r for r in left)
    # Merged, with the days before the fourth forgotten.
    ledger.compact(spark, 6, T0 + dt.timedelta(days=3))
    old = spark.createDataFrame([r for r in stored if r[3] % 100 == 0], EVENT)
    assert {r.event_id[1] for r in ledger.fresh(old, 7).collect()} == set("012")
    with pytest.raises(ValueError):
        ledger.fresh(batch, 6)


def test_full_filters_change_nothing(spark, tmp_path):
    from obsflow.streaming.ledger import Ledger

    ledger = Ledger(str(tmp_path), buckets=2, blocks=1)
    df = spark.createDataFrame([("t", f"e{i}", T0, i) for i in range(4000)], EVENT)
    ledger.record(df, 0)
    both = df.union(spark.createDataFrame([("t", f"f{i}", T0, i) for i in range(50)], EVENT))
    assert {r.event_id for r in ledger.fresh(both, 1).collect()} == {f"f{i}" for i in range(50)}
    assert ledger.fresh(spark.createDataFrame([], EVENT), 1).count() == 0 and Ledger(str(tmp_path / "none")).fresh(df, 0).count() == 4000


def test_streamed_appends_write_each_event_once(spark, tmp_path):
    from obsflow.streaming.ledger import Ledger, append_sink
    from obsflow.streaming.pipeline import parquet_sink, run_pipeline

    source, out, failed = str(tmp_path / "in"), str(tmp_path / "out"), []
    for part in range(3):
        spark.createDataFrame([("t", f"e{i}", T0 + dt.timedelta(seconds=i), i) for i in range(part * 100, part * 100 + 150)], EVENT).coalesce(1).write.mode("append").parquet(source)
    ledger, write = Ledger(str(tmp_path / "ledger"), buckets=4, blocks=16), parquet_sink(out)

    def breaks(df, batch_id):
        write(df, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after the write")

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        query = run_pipeline(stream, lambda df: df, {"out": append_sink(ledger, breaks)}, str(tmp_path / "checkpoint"))
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001
            assert "lost after the write" in str(e)
    assert failed == [1] and sorted(r.n for r in spark.read.parquet(out).collect()) == list(range(350))


def test_states_of_batches_equal_those_of_all_rows(spark, tmp_path):
    from obsflow.operators import cardinality as K
    from obsflow.operators import schemas
    from obsflow.streaming.store import BatchState

    rng = random.Random(5)
    payloads = ['{"a":1}', '{"a":"x"}', '{"a":1,"b":{"c":true}}', "{}"]
    rows = [(f"e{i:03d}", T0 + dt.timedelta(seconds=i), "t", "s", "x", rng.choice(["1", "2"]), None, {"k": str(i % 40)}, rng.choice(payloads), None, None) for i in range(240)]
    cols = "event_id string, event_time timestamp, tenant_id string, source string, event_type string, schema_version string, schema_url string, tags map<string,string>, payload string, metric_value double, metric_unit string"
    df = spark.createDataFrame(rows, cols)
    parts = [spark.createDataFrame(rows[i::3], cols) for i in range(3)]
    make = lambda df: schemas.states(schemas.describe(df), [])
    sketches = lambda df: K.sketch(K.tag_rows(df))
    registry = BatchState(str(tmp_path / "registry"), make(df).schema, make, schemas.merge_states)
    counts = BatchState(str(tmp_path / "sketches"), sketches(df).schema, sketches, K.merge_sketches)
    for batch_id, part in ((0, 0), (1, 2), (1, 1), (2, 2)):  # batch 1 runs twice, the second time with other rows
        registry.add(parts[part], batch_id)
        counts.add(parts[part], batch_id)
    want = sorted(map(tuple, schemas.schema_registry(schemas.describe(df)).collect()))
    told = sorted(map(tuple, K.sketched(sketches(df)).collect()))
    for compacted in (None, 1, 2, 2):
        if compacted is not None:
            registry.compact(spark, compacted)
            counts.compact(spark, compacted)
        assert sorted(map(tuple, schemas.registry_of(registry.read(spark)).collect())) == want
        assert sorted(map(tuple, K.sketched(counts.read(spark)).collect())) == told
    assert [r.observed for r in K.sketched(counts.read(spark)).collect()] and len(list((tmp_path / "registry").iterdir())) == 1


def make_topic(spark, path, batches):
    from obsflow.sources.topics import write_topic

    for batch_id, rows in batches:
        write_topic(spark.createDataFrame(rows, "key string, value string, n int"), path, batch_id, partitions=4, order=("n",))


def test_topic_keeps_order_and_repeated_batches_once(spark, tmp_path):
    from obsflow.sources.topics import read_topic, topic_rows

    path = str(tmp_path / "topic")
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", str(i), i) for i in range(9000)]
    make_topic(spark, path, [(0, rows[:5000]), (1, rows[5000:]), (1, rows[5000:]), (0, rows[:5000])])
    got = read_topic(spark, path).collect()
    assert sorted(int(r.value) for r in got) == list(range(9000))
    by_key, by_part = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.partition, r.offset)):
        by_key[r.key].append(int(r.value))
        by_part[r.partition].append(r.offset)
    assert all(v == sorted(v) for v in by_key.values()) and all(v == list(range(len(v))) for v in by_part.values())
    assert read_topic(spark, str(tmp_path / "none")).count() == 0
    # A partition's records in several tasks have no order, and are refused without a trace.
    loose = topic_rows(spark.createDataFrame(rows[:100], "key string, value string, n int"), 4, ["n"]).repartition(3)
    with pytest.raises(Exception, match="several tasks"):
        loose.write.format("obsflow-topic").mode("append").option("path", path).save()
    assert read_topic(spark, path).count() == 9000 and not list((tmp_path / "topic" / "staged").iterdir())


def test_topic_stream_goes_on_after_a_failure(spark, tmp_path):
    from obsflow.sources.topics import Topic, stream_topic

    path, checkpoint = str(tmp_path / "topic"), str(tmp_path / "checkpoint")
    rows = [(f"k{i % 5}", str(i), i) for i in range(600)]
    make_topic(spark, path, [(0, rows[:400])])
    seen, failed = [], []

    def each(batch, batch_id):
        held = [(r.partition, r.offset, r.key, int(r.value)) for r in batch.collect()]
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("killed between two batches")
        seen.append((batch_id, held))

    def run():
        query = stream_topic(spark, path, "g", limit=25).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        # A limited batch isn't all there is, so this waits until nothing is left to read, or the query has failed.
        for _ in range(600):
            time.sleep(0.1)
            if not query.isActive or query.lastProgress and not (query.status["isDataAvailable"] or query.status["isTriggerActive"]):
                break
        error = query.exception()
        assert error is None or "killed between" in str(error)
        query.stop()

    run()
    assert failed == [2] and [b for b, _ in seen] == [0, 1]
    make_topic(spark, path, [(1, rows[400:])])
    run()
    run()
    ids = [b for b, _ in seen]
    assert ids == list(range(len(ids))) and len(ids) > 5
    most = max(n for _, held in seen for n in collections.Counter(h[0] for h in held).values())
    assert most == 25
    flat = [h for _, held in seen for h in sorted(held)]
    assert sorted(h[3] for h in flat) == list(range(600))
    for part in {h[0] for h in flat}:
        assert [h[1] for h in flat if h[0] == part] == list(range(sum(h[0] == part for h in flat)))
    for key in {h[2] for h in flat}:
        values = [h[3] for h in flat if h[2] == key]
        assert values == sorted(values)
    done = Topic(path).load("g-done")
    ends = {p: s[-1].end for p, s in Topic(path).segments().items()}
    assert done and all(0 < done[p] <= ends[p] for p in done)


def test_topic_partition_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """One key's records are sorted in tasks of bounded size, are there all at once, and a batch that was cut short is written anew."""
    from obsflow.sources import topics

    monkeypatch.setattr(topics, "DEALT", 100)
    path = str(tmp_path / "topic")
    make_topic(spark, path, [(0, [("k", str(i), i) for i in range(999, -1, -1)])])
    topic = topics.Topic(path)
    (held,) = [s for s in topic.segments().values() if s]
    assert len(held) > 5 and max(s.count for s in held) < 300
    read = topics.read_topic(spark, path)
    assert [r.value for r in sorted(read.collect(), key=lambda r: r.offset)] == [str(i) for i in range(1000)]
    # As if the writer had died before the first of its segments was in place.
    topic.fs.delete_file(held[0].path)
    assert read.sparkSession.read.format("obsflow-topic").option("path", path).load().count() == 0
    make_topic(spark, path, [(0, [("k", str(i), i) for i in range(1000)]), (0, [("k", "again", 0)])])
    assert [r.value for r in sorted(topics.read_topic(spark, path).collect(), key=lambda r: r.offset)] == [str(i) for i in range(1000)]

"""Queries of what grows by micro-batches: ledger, states by batch and ordered topics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from obsflow.operators import cardinality as K
from obsflow.operators import schemas as S
from obsflow.operators.numbering import numbered_in
from obsflow.plans.basic import ORACLES, query
from obsflow.plans.records import VERSION
from obsflow.plans.views import events
from obsflow.sources import export, topics
from obsflow.staging import shared_dir, stage
from obsflow.streaming.ledger import Ledger
from obsflow.streaming.store import BatchState


def _place(spark, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(spark)}/obsflow/{name}-{uuid.uuid4().hex}"


@query(ORACLES["s8_append_dedup"], raw=True)
def s8_append_ledger(spark, sf_dir):
    ev, ledger = events(spark, sf_dir), Ledger(_place(spark, "ledger"))
    ledger.record(ev.where("n % 3 = 0"), 0)
    return ledger.fresh(ev.unionByName(ev.where("n % 5 = 0")), 1, ("event_time", "n")).select("tenant_id", "event_id", "event_type")


@query("select tenant_id, event_id, case when n%3=2 then 1 else 0 end batch from ev")
def st2_batches_once(spark, sf_dir):
    """Three batches that overlap by half; the second runs twice."""
    ev, ledger = events(spark, sf_dir), Ledger(_place(spark, "ledger"))
    through = []
    for batch, left_out in ((0, 2), (1, 0), (1, 0), (2, 1)):
        fresh = stage(ledger.fresh(ev.where(F.col("n") % 3 != left_out), batch, ("event_time", "n")).select("tenant_id", "event_id", "event_time"), "fresh")
        ledger.record(fresh, batch)
        through = [*through[:batch], fresh.select("tenant_id", "event_id", F.lit(batch).alias("batch"))]
    return reduce(lambda a, b: a.union(b), through)


def _by_batches(spark, sf_dir, name: str, make, merge):
    """State after three batches, of which the second ran twice and the first two are merged."""
    ev = events(spark, sf_dir)
    state = BatchState(_place(spark, name), make(ev).schema, make, merge)
    for batch in (0, 1, 1, 2):
        state.add(ev.where(F.col("n") % 3 == batch), batch)
    state.compact(spark, 1)
    return state.read(spark)


@query(ORACLES["a13_schema_registry"], raw=True)
def st8_registry_by_batches(spark, sf_dir):
    found = _by_batches(spark, sf_dir, "registry", lambda df: S.states(S.describe(df), []), S.merge_states)
    return S.registry_of(found).select(*VERSION, "path", "type", "seen", "conflicts", "observations", "required", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query(ORACLES["a5_merge_cardinality"], raw=True)
def st8_sketches_by_batches(spark, sf_dir):
    found = _by_batches(spark, sf_dir, "sketches", lambda df: K.sketch(K.tag_rows(df)), K.merge_sketches)
    return K.sketched(found).select(*K.KEY[:4], F.unix_micros("hour").alias("hour_us"), "observed")


ORDERED = "select tenant_id||'|'||source as key, event_id, row_number() over (partition by tenant_id, source order by event_time, event_id) nth from ev"


def _topic(spark, sf_dir) -> str:
    """The path of a topic of all events, as the stream sink shapes them."""
    path, ev = _place(spark, "topic"), events(spark, sf_dir)
    rows = export.to_kafka_rows(ev).select("key", "value", F.get_json_object("value", "$.event_id").alias("event_id"), F.to_timestamp(F.get_json_object("value", "$.event_time")).alias("event_time"))
    topics.write_topic(rows, path, 0)
    return path


#: Offsets in which a key's records are numbered together.
BLOCK = 50_000


def _in_order(records):
    """Records with their place in their key, by offset; a key lies in one partition, which is numbered in blocks."""
    rows = records.selectExpr("key", "get_json_object(value, '$.event_id') event_id", "offset", f"floor(offset / {BLOCK}) _bin")
    return numbered_in(rows, ["key"], ["offset"], "nth").select("key", "event_id", "nth")


@query(ORDERED)
def s10_topic(spark, sf_dir):
    return _in_order(topics.read_topic(spark, _topic(spark, sf_dir)))


@query(ORDERED)
def s2_topic_stream(spark, sf_dir):
    path, out = _topic(spark, sf_dir), _place(spark, "streamed")
    stream = topics.stream_topic(spark, path)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _in_order(spark.read.schema(stream.schema).parquet(out))

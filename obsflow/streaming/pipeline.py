"""Streams: the batch operators inside micro-batches, watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from obsflow.functions import exprs as X
from obsflow.operators import tables

Step = Callable[[DataFrame], DataFrame]


def pipeline(*steps: Step) -> Step:
    """Steps one after another."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def run_pipeline(stream: DataFrame, step: Step, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Run a step on each micro-batch and hand its result to every sink with the batch's id.

    A batch that fails is run again with the same id, so sinks that keep the id
    write each batch once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        out = step(batch).persist()
        try:
            for write in sinks.values():
                write(out, batch_id)
        finally:
            out.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that overwrites its own batch's folder, so a repeated batch leaves no second copy."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def dedup_stream(stream: DataFrame, horizon: str = "30 days", time: str = "event_time") -> DataFrame:
    """The first of each (tenant, event) within the horizon."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def windowed_stats(stream: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events, errors and largest value of each tenant, source and tumbling window."""
    rows = stream.withWatermark("event_time", delay)
    out = rows.groupBy(F.window("event_time", width), "tenant_id", "source").agg(F.count(F.lit(1)).alias("events"), F.count_if(X.is_error()).alias("errors"), F.max("metric_value").alias("largest"))
    return out.select("tenant_id", "source", F.col("window.start").alias("start"), "events", "errors", "largest")


def with_lateness(batch: DataFrame, newest, delay_seconds: int = 600) -> tuple[DataFrame, DataFrame]:
    """A batch's events on time and late: behind the newest time seen by more than the delay."""
    bound = F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
    return batch.where(F.col("event_time") >= bound), batch.where(F.col("event_time") < bound)


def split_failures(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to go on with, and dead letters for those that no retry can mend. Transient failures are Spark's task retries."""
    ok, bad = tables.validate(batch)
    return ok, bad.withColumn("class", F.lit("permanent"))


def decisions_once(decided: DataFrame, store: DataFrame) -> DataFrame:
    """Stored decisions where there are any, else the new ones: a retry changes nothing."""
    return tables.insert_absent(decided, store, ["tenant_id", "event_id"], ["event_id"])


def merge_batch(batch: DataFrame, store: DataFrame, keys: list[str], order: str, spec: dict[str, str]) -> DataFrame:
    """The store's state after a batch."""
    return tables.upsert(batch, store, keys, order, spec)


class KeyedSpacing(StatefulProcessor):
    """Lets through a key's event if its last one let through lies ``seconds`` back; state ends by TTL.

    For ``transformWithStateInPandas``; each key keeps one number.
    """

    def __init__(self, seconds: int, time: str = "event_time"):
        self.width = seconds * 1_000_000
        self.time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]), ttlDurationMs=max(self.width // 1000 * 4, 60_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(self.time)
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for us in held[self.time].astype("datetime64[us]").astype("int64"):
            keep.append(last is None or us - last >= self.width)
            last = us if keep[-1] else last
        self.last.update((int(last),))
        yield held[keep]

    def close(self) -> None:
        pass


def spaced_stream(stream: DataFrame, keys: list[str], seconds: int, time: str = "event_time") -> DataFrame:
    """A stream's events spaced by ``seconds`` within each key, as :class:`KeyedSpacing` does it, by grouped state.

    A key's state is one number, and goes when nothing came for four spacings (a minute at least).
    """
    width = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pd.concat(list(frames)).sort_values(time)
        last = state.get[0] if state.exists else None
        keep = []
        for us in held[time].astype("datetime64[us]").astype("int64"):
            keep.append(last is None or us - last >= width)
            last = us if keep[-1] else last
        state.update((int(last),))
        state.setTimeoutDuration(max(width // 1000 * 4, 60_000))
        yield held[keep]

    return stream.groupBy(*keys).applyInPandasWithState(step, stream.schema, "us long", "append", GroupStateTimeout.ProcessingTimeTimeout)

"""Incident detection on streams, with keyed state and event-time timers.

The result is that of the batch detector whatever the order of arrival, as long as
events come within the watermark's delay: a key's events wait in its state until
the watermark has passed them, and are then looked at in the order of their time.
State of a key is what waits, the error times of one window and the last trigger
of each category. What the watermark has left behind can change nothing more and
goes, by a timer of its own, so a silent key keeps no state. Needs the RocksDB
state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from obsflow.functions import exprs as X
from obsflow.operators.evidence import as_incidents

_WAITING = StructType([StructField("us", LongType()), StructField("event_id", StringType()), StructField("slow", BooleanType()), StructField("error", BooleanType()), StructField("metric_value", DoubleType())])
_TRIGGER = "tenant_id string, source string, category string, event_us long, event_id string, metric_value double, recent_errors long"
CATEGORIES = ("latency", "errors")


def triggers(rows: list[tuple], errors: list[int], last: dict[str, int], least: int, window_us: int, cooldown_us: int) -> tuple[list[tuple], list[int], dict[str, int]]:
    """Triggers among waiting rows (in order of time), and the error times and last triggers after them.

    Errors of the same time count for each other, as in the batch detector's range.
    """
    found, at = [], 0
    while at < len(rows):
        us, upto = rows[at][0], at
        while upto < len(rows) and rows[upto][0] == us:
            upto += 1
        now = rows[at:upto]
        errors = [e for e in errors if e > us - window_us] + [us for r in now if r[3] and not r[2]]
        for _, event_id, slow, error, value in now:
            category = "latency" if slow else "errors" if error and len(errors) >= least else None
            if category and (category not in last or us - last[category] >= cooldown_us):
                last[category] = us
                found.append((category, us, event_id, value, len(errors)))
        at = upto
    return found, errors, last


class IncidentDetector(StatefulProcessor):
    """The detector of one (tenant, source)."""

    def __init__(self, errors: int, window: int, cooldown: int):
        self.least, self.window, self.cooldown = errors, window * 1_000_000, cooldown * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.errors = handle.getListState("errors", StructType([StructField("us", LongType())]))
        self.last = handle.getValueState("last", StructType([StructField(c, LongType()) for c in CATEGORIES]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = 0
        for held in rows:
            us = held["event_time"].astype("datetime64[us]").astype("int64")
            values = [None if pd.isna(v) else float(v) for v in held["metric_value"]]
            more = list(zip(us.tolist(), held["event_id"].tolist(), held["slow"].astype(bool).tolist(), held["error"].astype(bool).tolist(), values, strict=True))
            if more:
                self.waiting.appendList(more)
                newest = max(newest, int(us.max()))
        if newest:
            # One timer for all that came; what is due by then is looked at together.
            self.handle.registerTimer(newest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        errors = [r[0] for r in self.errors.get()] if self.errors.exists() else []
        last = {c: us for c, us in zip(CATEGORIES, self.last.get(), strict=True) if us is not None} if self.last.exists() else {}
        found, errors, last = triggers(due, errors, last, self.least, self.window, self.cooldown)
        errors = [e for e in errors if e > passed - self.window]
        last = {c: us for c, us in last.items() if us > passed - self.cooldown}
        for state, held in ((self.waiting, later), (self.errors, [(e,) for e in errors])):
            if held:
                state.put(held)
            else:
                state.clear()
        if last:
            self.last.update(tuple(last.get(c) for c in CATEGORIES))
        else:
            self.last.clear()
        ends = [e + self.window for e in errors] + [us + self.cooldown for us in last.values()]
        if ends:
            self.handle.registerTimer(max(ends) // 1000 + 1)
        if found:
            yield pd.DataFrame([(*key, *f) for f in found], columns=["tenant_id", "source", "category", "event_us", "event_id", "metric_value", "recent_errors"])

    def close(self) -> None:
        pass


def detect_stream(stream: DataFrame, latency_ms: float = 1000.0, errors: int = 5, window: int = 60, cooldown: int = 600, lookback: int = 900, delay: str = "10 minutes") -> DataFrame:
    """Incidents of a stream of events, each once, as :func:`obsflow.operators.evidence.detect_incidents` finds them.

    ``delay`` is how late an event may come; incidents are told when the watermark has passed them.
    """
    rows = stream.select("tenant_id", "source", "event_id", "event_time", "metric_value", F.coalesce(X.high_latency(latency_ms), F.lit(False)).alias("slow"), F.coalesce(X.is_error(), F.lit(False)).alias("error"))
    rows = rows.where("slow or error").withWatermark("event_time", delay)
    found = rows.groupBy("tenant_id", "source").transformWithStateInPandas(IncidentDetector(errors, window, cooldown), _TRIGGER, "append", "EventTime")
    found = found.withColumn("event_time", F.timestamp_micros("event_us"))
    return as_incidents(found, latency_ms, window, lookback)

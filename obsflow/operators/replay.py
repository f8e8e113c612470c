"""Replay of incidents under a policy, and what policies would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.operators import cardinality as K
from obsflow.operators import windows
from obsflow.operators.evidence import freeze
from obsflow.operators.folds import throttle
from obsflow.operators.tables import normalize
from obsflow.schema import CONTROL, Policy

SECONDS_PER_MONTH = 30 * 24 * 3600


def _scoped(ev: DataFrame) -> DataFrame:
    """Incidents are replayed apart: each event's tenant also names its incident."""
    return ev.withColumn("tenant_id", F.concat_ws("\x1f", "tenant_id", "incident_id"))


def _split(c: str = "tenant_id") -> tuple[Column, Column]:
    parts = F.split(c, "\x1f")
    return F.element_at(parts, 1).alias("tenant_id"), F.element_at(parts, 2).alias("incident_id")


def replay(ev: DataFrame, active: Policy, shadow: Policy | None = None) -> DataFrame:
    """For each frozen event: changed, dropped tags, quarantined, reported findings and shadow differences.

    Events are normalized first, as they were when they came in.
    """
    rows = _scoped(normalize(ev).drop("failed"))
    found = K.decisions(rows, active).where("act is not null")
    act = found.groupBy("tenant_id", "event_id").agg(F.count_if(F.col("act").isin("drop_tag", "quarantine")).alias("dropped"), F.bool_or(F.col("act") == "quarantine").alias("quarantined"))
    reported = throttle(found, ["tenant_id", "source", "event_type", "dimension", "act"]).groupBy("tenant_id", "event_id").agg(F.count(F.lit(1)).alias("findings"))
    out = rows.select("tenant_id", "event_id").join(act, ["tenant_id", "event_id"], "left").join(reported, ["tenant_id", "event_id"], "left")
    if shadow is not None:
        diffs = K.policy_diffs(rows, active, shadow).groupBy("tenant_id", "event_id").agg(F.count(F.lit(1)).alias("shadow_diffs"))
        out = out.join(diffs, ["tenant_id", "event_id"], "left")
    else:
        out = out.withColumn("shadow_diffs", F.lit(0))
    out = out.fillna(0, ["dropped", "findings", "shadow_diffs"]).fillna({"quarantined": False})
    return out.select(*_split(), "event_id", ((F.col("dropped") > 0) | F.col("quarantined")).alias("changed"), "dropped", "quarantined", "findings", "shadow_diffs")


def replay_totals(results: DataFrame) -> DataFrame:
    """Totals of each replayed incident."""
    return results.groupBy("tenant_id", "incident_id").agg(F.count(F.lit(1)).alias("events"), F.count_if("changed").alias("changed"), F.sum("dropped").alias("dropped"), F.count_if("quarantined").alias("quarantined"), F.sum("findings").alias("findings"), F.sum("shadow_diffs").alias("shadow_diffs"))


def replay_incidents(incidents: DataFrame, captures: DataFrame, active: Policy, shadow: Policy | None = None) -> DataFrame:
    """What :func:`replay` says of the frozen events of incidents, which aren't laid out for it."""
    kinds = "tenant_id string, incident_id string, event_id string, changed boolean, dropped long, quarantined boolean, findings long, shadow_diffs long"
    out, left = windows.by_groups(incidents, normalize(captures), windows.replay_group(active, shadow, False), kinds, ["source", "event_type", "tags"])
    return out if left is None else out.unionByName(replay(freeze(left, captures), active, shadow))


def replay_incident_totals(incidents: DataFrame, captures: DataFrame, active: Policy, shadow: Policy | None = None) -> DataFrame:
    """What :func:`replay_totals` says of incidents with events, counted where their events are."""
    kinds = "tenant_id string, incident_id string, events long, changed long, dropped long, quarantined long, findings long, shadow_diffs long"
    out, left = windows.by_groups(incidents, normalize(captures), windows.replay_group(active, shadow, True), kinds, ["source", "event_type", "tags"])
    return out if left is None else out.unionByName(replay_totals(replay(freeze(left, captures), active, shadow)))


def _profile(ev: DataFrame, name: str) -> DataFrame:
    # Bytes are those of the event, whose tenant is the scope's first part.
    rows = ev.withColumn("_scope", F.col("tenant_id")).withColumn("tenant_id", _split()[0])
    return rows.groupBy("_scope").agg(F.sum(X.canonical_bytes()).alias(f"{name}_bytes"), F.count_distinct(F.sha2(X.series_id().cast("binary"), 256)).alias(f"{name}_series")).withColumnRenamed("_scope", "tenant_id")


def cost_simulation(ev: DataFrame, active: Policy, shadow: Policy | None = None, per_gb: float = 0.0, per_1000_series: float = 0.0, control: str = CONTROL) -> DataFrame:
    """Bytes, series and changed events of each incident, as captured and under the policies, scaled to 30 days."""
    rows = _scoped(ev)
    span = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("events"), F.greatest((F.unix_micros(F.max("event_time")) - F.unix_micros(F.min("event_time"))) / 1e6, F.lit(1.0)).alias("window_seconds"))
    out = span.join(_profile(rows, "baseline"), "tenant_id")
    for name, policy in (("active", active), ("shadow", shadow)):
        shaped = K.apply_policy(rows, policy, control)[0] if policy else rows
        out = out.join(_profile(shaped, name), "tenant_id")
        before = rows.select("tenant_id", "event_id", F.map_entries("tags").alias("_b"))
        changed = shaped.join(before, ["tenant_id", "event_id"]).groupBy("tenant_id").agg(F.count_if(F.array_sort(F.map_entries("tags")) != F.array_sort("_b")).alias(f"{name}_changed"))
        out = out.join(changed, "tenant_id")
    out = _priced(out, per_gb, per_1000_series)
    return out.select(*_split(), *(c for c in out.columns if c != "tenant_id"))


def cost_incidents(incidents: DataFrame, captures: DataFrame, active: Policy, shadow: Policy | None = None, per_gb: float = 0.0, per_1000_series: float = 0.0, control: str = CONTROL) -> DataFrame:
    """What :func:`cost_simulation` says of incidents with events, counted where their events are."""
    rows = captures.withColumn("bytes", X.canonical_bytes())
    out, left = windows.by_groups(incidents, rows, windows.cost_group(active, shadow, control), windows.COUNTED, ["source", "event_type", "tags", "bytes"])
    out = _priced(out, per_gb, per_1000_series)
    return out if left is None else out.unionByName(cost_simulation(freeze(left, captures), active, shadow, per_gb, per_1000_series, control))


def _priced(out: DataFrame, per_gb: float, per_1000_series: float) -> DataFrame:
    """Adds the scaled figures."""
    for name in ("baseline", "active", "shadow"):
        gb = F.col(f"{name}_bytes") * (SECONDS_PER_MONTH / F.col("window_seconds")) / 1024**3
        out = out.withColumn(f"{name}_gb_month", gb)
        if per_gb > 0 or per_1000_series > 0:
            out = out.withColumn(f"{name}_cost_month", gb * per_gb + F.col(f"{name}_series") / 1000 * per_1000_series)
    return out

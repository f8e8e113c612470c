"""Operational changes: markers, before/after comparison, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.operators.intervals import interval_join
from obsflow.operators.stats import exact_p95
from obsflow.schema import CONTROL
from obsflow.staging import stage

KINDS = ("deployment", "rollback", "release", "feature_flag", "configuration", "infrastructure")
STATUSES = ("started", "completed", "failed", "rolled_back", "changed")


def _seconds(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def change_markers(df: DataFrame, control: str = CONTROL) -> DataFrame:
    """A marker for each change event; ``valid`` where its identity, kind and status hold."""
    own = lambda name, *keys: X.first_tag(control + name, *keys)
    told = F.lower(own("change_kind", "change_kind"))
    kind = F.lower("event_type")
    inferred = (
        F.when(kind.contains("rollback"), "rollback").when(kind.contains("deploy"), "deployment").when(kind.contains("release"), "release")
        .when(kind.contains("feature") & kind.contains("flag"), "feature_flag").when(kind.contains("config"), "configuration").otherwise("infrastructure")
    )
    summary = F.coalesce(own("change_summary", "change_summary"), X.filled(F.get_json_object("payload", "$.summary")))
    rows = df.where(X.is_change(control)).select(
        "tenant_id", F.coalesce(X.first_tag(control + "change_id", "change_id", "deployment_id"), F.concat(F.lit("CHG-"), "event_id")).alias("change_id"),
        "event_id", "source", F.when(told.isin(*KINDS), told).otherwise(inferred).alias("kind"),
        F.coalesce(own("change_status", "change_status", "status"), F.lit("completed")).alias("status"),
        own("environment", "environment", "deployment.environment").alias("environment"), own("version", "version", "release").alias("version"),
        own("previous_version", "previous_version").alias("previous_version"), own("git_sha", "git_sha", "git.commit.sha", "vcs.revision").alias("git_sha"),
        own("build_id", "build_id").alias("build_id"), own("change_actor", "actor").alias("actor"), own("rollback_of", "rollback_of").alias("rollback_of"),
        summary.alias("summary"), F.col("event_time").alias("changed_at"),
    )
    valid = X.filled(F.col("event_id")).isNotNull() & X.filled(F.col("source")).isNotNull() & F.col("changed_at").isNotNull() & F.col("status").isin(*STATUSES)
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


def merge_markers(markers: DataFrame) -> DataFrame:
    """One row for each (tenant, change): last status and time, last known details, first source and event."""
    at = F.struct("changed_at", "event_id")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    details = ("environment", "version", "previous_version", "git_sha", "build_id", "actor", "rollback_of", "summary")
    return markers.groupBy("tenant_id", "change_id").agg(
        F.min_by("event_id", at).alias("event_id"), F.min_by("source", at).alias("source"), F.max_by("kind", at).alias("kind"),
        F.max_by("status", at).alias("status"), F.max("changed_at").alias("changed_at"), *map(known, details),
    )


#: Changes up to this many (each in a few time bins, some 100 bytes) are broadcast to the events.
FEW = 100_000


def most_in(ev: DataFrame, seconds: int) -> int:
    """A bound on the latencies of one source in any window of so many seconds: two bins of that width."""
    bins = ev.where(X.is_latency()).groupBy("tenant_id", "source", F.floor(F.unix_micros("event_time") / (seconds * 1_000_000)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    return 2 * (bins.agg(F.max("_n")).collect()[0][0] or 0)


def before_after(markers: DataFrame, ev: DataFrame, before: int = 900, after: int = 900, few: bool = False, own: bool = False, most: int | None = None) -> DataFrame:
    """For each change and source: events, errors, error rate and p95 in [c-before, c) and in [c, c+after).

    ``few``: the changes were counted and are broadcast. ``own``: only each change's own source.
    ``most``: a known bound on the latencies of a source in a window (see :func:`most_in`).
    """
    most = most_in(ev, max(before, after)) if most is None else most
    spans = markers.select("tenant_id", "change_id", F.col("source").alias("change_source"), "changed_at")
    points = ev.select("tenant_id", "source", "event_time", "event_type", "tags", "metric_value", "metric_unit")
    end = F.col("changed_at") + _seconds(after) - _seconds(0.000001)
    keys = ["tenant_id", "source"] if own else ["tenant_id"]
    spans = spans.withColumn("source", F.col("change_source")) if own else spans
    rows = interval_join(spans, points, keys, F.col("changed_at") - _seconds(before), end, F.col("event_time"), max(before, after), few=few)
    past = F.col("event_time") < F.col("changed_at")
    sides = {"before": past, "after": ~past}
    counts = [c for name, side in sides.items() for c in (F.count_if(side).alias(f"{name}_events"), F.count_if(side & X.is_error()).alias(f"{name}_errors"))]
    out = exact_p95(rows, ["tenant_id", "change_id", "change_source", "source"], counts, {f"{name}_p95": side & X.is_latency() for name, side in sides.items()}, most=most)
    for name in ("before", "after"):
        out = out.withColumn(f"{name}_error_rate", F.when(F.col(f"{name}_events") > 0, F.col(f"{name}_errors") / F.col(f"{name}_events")).otherwise(0.0))
    return out


def assess(pairs: DataFrame) -> DataFrame:
    """Adds deltas and ``assessment`` of each (change, source)."""
    c = F.col
    rows = pairs.withColumn("error_rate_delta", c("after_error_rate") - c("before_error_rate")).withColumn("p95_delta", c("after_p95") - c("before_p95"))
    slower = (c("before_p95") > 0) & (c("p95_delta") >= 100) & (c("after_p95") >= c("before_p95") * 1.25)
    worse = (c("error_rate_delta") >= 0.05) & (c("after_errors") >= c("before_errors") + 2)
    faster = (c("before_p95") > 0) & (c("p95_delta") <= -100) & (c("after_p95") <= c("before_p95") * 0.75)
    better = (c("error_rate_delta") <= -0.05) & (c("before_errors") >= c("after_errors") + 2)
    few = (c("before_events") < 5) | (c("after_events") < 5)
    return rows.withColumn("assessment", F.when(few, "insufficient").when(slower | worse, "regressed").when(faster | better, "improved").otherwise("unchanged"))


def blast_radius(impacts: DataFrame) -> DataFrame:
    """For each change: how many sources were seen, could be assessed, regressed and improved, and the overall assessment."""
    c = F.col
    is_ = lambda name: c("assessment") == name
    rows = impacts.groupBy("tenant_id", "change_id").agg(
        F.count(F.lit(1)).alias("observed_sources"), F.count_if(~is_("insufficient")).alias("assessable_sources"), F.count_if(is_("regressed")).alias("regressed_sources"),
        F.count_if(is_("improved")).alias("improved_sources"), F.max(F.when(c("source") == c("change_source"), c("assessment"))).alias("primary_assessment"),
    )
    share = F.when(c("assessable_sources") > 0, c("regressed_sources") / c("assessable_sources") * 100).otherwise(0.0)
    primary = F.coalesce(c("primary_assessment"), F.lit(""))
    overall = (
        F.when(primary == "regressed", "regression-associated").when((c("regressed_sources") > 0) & (c("improved_sources") > 0), "mixed")
        .when(c("regressed_sources") > 0, "regression-observed").when(primary == "improved", "improvement-associated")
        .when(c("assessable_sources") == 0, "insufficient-evidence").otherwise("no-material-regression")
    )
    return rows.withColumn("blast_radius_percent", share).withColumn("overall", overall)


def recovery_rollback(markers: DataFrame, seconds: int = 7200) -> DataFrame:
    """For each change the rollback that followed within two hours: one that names it, else the first on its source."""
    spans = markers.select("tenant_id", "change_id", F.col("source").alias("change_source"), "changed_at")
    rolls = markers.where("kind = 'rollback'").select("tenant_id", F.col("change_id").alias("rollback_id"), F.col("source").alias("rollback_source"), F.col("changed_at").alias("rolled_at"), "rollback_of")
    rows = interval_join(spans, rolls, ["tenant_id"], F.col("changed_at") + _seconds(0.000001), F.col("changed_at") + _seconds(seconds), F.col("rolled_at"), seconds)
    named = F.coalesce(F.col("rollback_of") == F.col("change_id"), F.lit(False))
    rows = rows.where(named | (F.col("rollback_source") == F.col("change_source"))).withColumn("named", named)
    w = W.partitionBy("tenant_id", "change_id").orderBy(F.col("named").desc(), "rolled_at", "rollback_id")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("tenant_id", "change_id", "change_source", "rollback_id", "rolled_at", "named")


def analyze_changes(markers: DataFrame, ev: DataFrame, before: int = 900, after: int = 900) -> DataFrame:
    """Impact, blast radius and recovery of all changes at once.

    Changes are made once; the events are read for each of the two windows, and
    move only where changes are too many to broadcast.
    """
    markers = stage(markers, "change-markers")
    few = markers.count() <= FEW
    most = most_in(ev, max(before, after, 600))
    overall = blast_radius(assess(before_after(markers, ev, before, after, few, most=most)))
    rolls = stage(recovery_rollback(markers), "change-rollbacks")
    at_roll = rolls.select("tenant_id", "change_id", F.col("change_source").alias("source"), F.col("rolled_at").alias("changed_at"))
    after_roll = assess(before_after(at_roll, ev, before, 600, few, own=True, most=most))
    calm = (F.col("after_error_rate") < 0.05) & ((F.col("after_p95") == 0) | (F.col("after_p95") < 500))
    recovered = after_roll.select("tenant_id", "change_id", ((F.col("assessment") == "improved") | calm).alias("recovered"))
    rows = markers.select("tenant_id", "change_id").join(overall, ["tenant_id", "change_id"], "left").join(rolls.select("tenant_id", "change_id", "rollback_id"), ["tenant_id", "change_id"], "left")
    rows = rows.join(recovered, ["tenant_id", "change_id"], "left")
    none = {c: 0 for c in ("observed_sources", "assessable_sources", "regressed_sources", "improved_sources")}
    return rows.fillna(none).fillna({"blast_radius_percent": 0.0, "overall": "insufficient-evidence", "recovered": False})


def changes_near(windows: DataFrame, markers: DataFrame, before: int = 900, after: int = 300) -> DataFrame:
    """Markers near an incident's frozen events: (tenant_id, incident_id, first_at, last_at) give its span."""
    rows = interval_join(windows, markers, ["tenant_id"], F.col("first_at") - _seconds(before), F.col("last_at") + _seconds(after), F.col("changed_at"), 3600)
    return rows.drop("first_at", "last_at")

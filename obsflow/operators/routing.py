"""Routing plans, the delivery outbox and destination health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.operators.tables import set_changes
from obsflow.schema import CONTROL, RoutingConfig


def destinations(cfg: RoutingConfig, exclude_quarantined: bool = False) -> Column:
    """An event's (destination, rule) pairs in rule order; the fallback only if no rule matches."""
    enabled = {d.name for d in cfg.destinations if d.enabled}
    none = F.expr("cast(array() as array<struct<destination:string,rule:string>>)")
    pairs, matched, stopped = none, F.lit(False), F.lit(False)
    for rule in cfg.rules:
        hit = X.rule_matches(rule) & ~stopped
        own = [F.struct(F.lit(d).alias("destination"), F.lit(rule.name).alias("rule")) for d in rule.destinations if d in enabled]
        if own:
            pairs = F.concat(pairs, F.when(hit, F.array(*own)).otherwise(none))
        matched = matched | hit
        if rule.stop:
            stopped = stopped | hit
    if cfg.fallback_destination:
        pairs = F.when(matched, pairs).otherwise(F.array(F.struct(F.lit(cfg.fallback_destination).alias("destination"), F.lit("fallback").alias("rule"))))
    if exclude_quarantined:
        pairs = F.when(F.coalesce(X.tag(CONTROL + "quarantined") == "true", F.lit(False)), none).otherwise(pairs)
    return pairs


def route(df: DataFrame, cfg: RoutingConfig, exclude_quarantined: bool = False) -> DataFrame:
    """A row for each event and destination: the rules that lead there, and its delivery settings."""
    # All pairs of an event are in one row, so destinations are grouped without a shuffle.
    pairs = F.col("_pairs")
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["destination"])))
    rules = F.transform(names, lambda d: F.struct(d.alias("destination"), F.array_join(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["destination"] == d), lambda p: p["rule"])), ",").alias("rules")))
    rows = df.withColumn("_pairs", destinations(cfg, exclude_quarantined)).withColumn("_d", F.explode(rules)).select("tenant_id", "event_id", "_d.destination", "_d.rules")
    for name, default in (("max_attempts", 5), ("base_delay_ms", 500), ("max_delay_ms", 60_000), ("failure_fallback", "")):
        value = F.lit(default)
        for d in cfg.destinations:
            value = F.when(F.col("destination") == d.name, getattr(d, name)).otherwise(value)
        rows = rows.withColumn(name, value)
    return rows


def route_diffs(df: DataFrame, active: RoutingConfig, shadow: RoutingConfig) -> DataFrame:
    """Events whose set of destinations differs under the shadow config."""
    names = lambda cfg: F.array_sort(F.array_distinct(F.transform(destinations(cfg), lambda p: p["destination"])))
    rows = df.select("tenant_id", "event_id", names(active).alias("a"), names(shadow).alias("s"))
    added, removed = set_changes(F.col("a"), F.col("s"))
    rows = rows.withColumn("added", F.array_join(added, ",")).withColumn("removed", F.array_join(removed, ","))
    return rows.where("added != '' or removed != ''").select("tenant_id", "event_id", "added", "removed")


def advance(deliveries: DataFrame, outcomes: DataFrame, cfg: RoutingConfig, now) -> tuple[DataFrame, DataFrame]:
    """Deliveries after their attempts, and the rows that failure fallbacks add.

    Delivered, retry at now + delay, or dead_letter: a permanent failure or the last attempt.
    """
    at = F.lit(now).cast("timestamp")
    key = ["tenant_id", "event_id", "destination"]
    rows = deliveries.join(outcomes.select(*key, "ok", "retryable", F.col("error").alias("_error")), key, "left")
    tried = F.col("ok").isNotNull()
    attempts = F.col("attempts") + F.when(tried, 1).otherwise(0)
    dead = ~F.col("retryable") | (attempts >= F.col("max_attempts"))
    status = F.when(~tried, F.col("status")).when(F.col("ok"), "delivered").when(dead, "dead_letter").otherwise("retry")
    delay = X.retry_delay_ms(attempts, F.col("base_delay_ms"), F.col("max_delay_ms"))
    rows = rows.withColumn("_status", status).withColumn("_attempts", attempts)
    later = F.when(tried & (F.col("_status") == "retry"), F.timestamp_micros(F.unix_micros(at) + delay * 1000)).otherwise(F.col("next_attempt_at"))
    out = rows.withColumn("next_attempt_at", later).withColumn("status", F.col("_status")).withColumn("attempts", F.col("_attempts")).withColumn("last_error", F.when(tried & ~F.col("ok"), F.col("_error")).otherwise(F.col("last_error")))
    fresh = tried & (F.col("status") == "dead_letter")
    enabled = [d.name for d in cfg.destinations if d.enabled]
    spare = out.where(fresh & F.col("failure_fallback").isin(enabled)).select("tenant_id", "event_id", F.col("failure_fallback").alias("destination"), F.lit("pending").alias("status"), F.concat(F.lit("failure_fallback:"), "destination").alias("rules"))
    return out.drop("ok", "retryable", "_error", "_status", "_attempts"), spare


def requeue(dlq: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen dead letters to send again (to their topic unless a destination is named), and those refused: raw only."""
    rows = dlq.join(keys, "letter_id", "left_semi")
    whole = F.col("event").isNotNull()
    return rows.where(whole).withColumn("target", F.coalesce(X.filled(F.col("destination")), F.col("topic"))), rows.where(~whole)


def due_deliveries(deliveries: DataFrame, now, per_lane: int) -> DataFrame:
    """The oldest deliveries of each destination that are due or whose lease ran out."""
    at = F.lit(now).cast("timestamp")
    due = (F.col("status").isin("pending", "retry") & (F.col("next_attempt_at") <= at)) | ((F.col("status") == "leased") & (F.col("lease_until") < at))
    w = W.partitionBy("destination").orderBy("created_at", "tenant_id", "event_id")
    return deliveries.where(due).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_lane).drop("_k")


def health_fold(attempts: DataFrame) -> DataFrame:
    """Each destination's failures since its last success, and what that makes it."""
    key = ["tenant_id", "destination"]
    last = F.max(F.when(F.col("ok"), F.struct("at", "seq"))).over(W.partitionBy(*key))
    rows = attempts.withColumn("_last", last)
    since = ~F.col("ok") & (F.col("_last").isNull() | (F.struct("at", "seq") > F.col("_last")))
    out = rows.groupBy(*key).agg(F.count_if(since).alias("consecutive_failures"), F.count_if(F.col("ok")).alias("successes"))
    n = F.col("consecutive_failures")
    return out.withColumn("health", F.when(n >= 5, "unhealthy").when(n > 0, "degraded").otherwise("healthy"))


def destination_health(deliveries: DataFrame, health: DataFrame, dlq: DataFrame) -> DataFrame:
    """Every destination named anywhere: delivery counts, health and dead letters. Inputs are summed before they join."""
    key = ["tenant_id", "destination"]
    names = deliveries.select(*key).union(health.select(*key)).union(dlq.select(*key)).distinct()
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = deliveries.groupBy(*key).agg(is_("pending").alias("pending"), is_("retry").alias("retrying"), is_("delivered").alias("delivered"))
    letters = dlq.groupBy(*key).agg(F.count(F.lit(1)).alias("dead_letters"))
    out = names.join(counts, key, "left").join(letters, key, "left").join(health.select(*key, "health", "consecutive_failures"), key, "left")
    return out.fillna(0, ["pending", "retrying", "delivered", "dead_letters", "consecutive_failures"]).fillna("unknown", ["health"])

"""Sinks' row shapes: stream records, JSON, OTLP, Prometheus samples and log collectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions import exprs as X


def _event_json() -> Column:
    return F.to_json(F.struct("event_id", "tenant_id", "source", "event_type", "event_time", "tags", "payload", "metric_value", "metric_unit", "schema_version", "correlation_id"))


def capture(df: DataFrame, captured_at) -> DataFrame:
    """Flight-recorder rows: the whole envelope before anything changes it."""
    return df.select("tenant_id", "event_id", F.lit(captured_at).cast("timestamp").alias("captured_at"), "event_time", "source", "event_type", _event_json().alias("envelope"))


def to_kafka_rows(df: DataFrame) -> DataFrame:
    """key, value and headers of a record; the key keeps a tenant's source in order."""
    header = lambda name, c: F.struct(F.lit(name).alias("key"), F.col(c).cast("binary").alias("value"))
    return df.select(F.concat_ws("|", "tenant_id", "source").alias("key"), _event_json().alias("value"), F.array(header("event_id", "event_id"), header("tenant_id", "tenant_id"), header("schema_version", "schema_version")).alias("headers"))


def export_http_json(df: DataFrame) -> DataFrame:
    """Canonical JSON and its idempotency key."""
    return df.select(F.concat_ws(":", "tenant_id", "event_id").alias("idempotency_key"), _event_json().alias("body"))


def export_otlp(df: DataFrame) -> DataFrame:
    """OTLP items: numeric events as gauge points, others as log records."""
    attributes = F.transform(X.sorted_tags(None), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    nanos = (F.unix_micros("event_time") * 1000).cast("string")
    point = F.to_json(F.struct(F.col("event_type").alias("name"), F.col("metric_unit").alias("unit"), F.struct(F.array(F.struct(nanos.alias("timeUnixNano"), F.col("metric_value").alias("asDouble"), attributes.alias("attributes"))).alias("dataPoints")).alias("gauge")))
    record = F.to_json(F.struct(nanos.alias("timeUnixNano"), X.severity().alias("severityText"), F.struct(F.coalesce("payload", F.col("event_type")).alias("stringValue")).alias("body"), attributes.alias("attributes")))
    metric = F.col("metric_value").isNotNull()
    return df.select("tenant_id", "source", F.when(metric, "metrics").otherwise("logs").alias("signal"), "event_id", F.when(metric, point).otherwise(record).alias("item"))


def export_prom(df: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Prometheus samples of numeric events: sanitized name and labels, value, milliseconds."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), "^([0-9])", "_$1")
    kept = F.map_filter("tags", lambda k, v: k.isin(*allow)) if allow else F.create_map().cast("map<string,string>")
    labels = F.array_sort(F.concat(
        F.array(F.concat(F.lit("__name__="), clean(F.col("event_type"))), F.concat(F.lit("source="), "source"), F.concat(F.lit("tenant_id="), "tenant_id")),
        F.transform(F.map_entries(kept), lambda e: F.concat(clean(e["key"]), F.lit("="), e["value"])),
    ))
    return df.where("metric_value is not null").select("event_id", F.array_join(labels, ",").alias("labels"), F.col("metric_value").alias("value"), F.unix_millis("event_time").alias("timestamp_ms"))


def export_hec(df: DataFrame) -> DataFrame:
    """Log-collector envelopes: seconds with milliseconds, source, type and event."""
    body = F.struct((F.unix_millis("event_time").cast("decimal(20,0)") / 1000).cast("decimal(20,3)").alias("time"), F.col("source").alias("source"), F.col("event_type").alias("sourcetype"), F.struct(*(c for c in ("event_id", "tenant_id", "tags", "payload", "metric_value"))).alias("event"))
    return df.select("event_id", F.to_json(body).alias("body"))


def export_dd(df: DataFrame) -> DataFrame:
    """Datadog-log-shaped items."""
    tags = F.array_join(F.transform(X.sorted_tags(None), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return df.select("event_id", F.coalesce(X.filled(F.col("payload")), F.col("event_type")).alias("message"), F.coalesce(F.nullif(X.severity(), F.lit("")), F.lit("info")).alias("status"), F.col("source").alias("service"), tags.alias("ddtags"))

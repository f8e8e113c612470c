"""The canonical event and the small policy documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
    T.StructField("metric_unit", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("schema_url", T.StringType()),
    T.StructField("correlation_id", T.StringType()),
])

#: Prefix of tags that the engine itself writes.
CONTROL = "ctl."


@dataclass(frozen=True)
class CardinalityRule:
    source: str = "*"
    type: str = "*"
    dimension: str = "*"
    unique_threshold: int = 100
    action: str = "allow"


@dataclass(frozen=True)
class Budget:
    name: str
    source: str = "*"
    type: str = "*"
    series_limit: int = 1000
    warning_percent: float = 70.0
    critical_percent: float = 90.0


@dataclass(frozen=True)
class Policy:
    """A cardinality policy: the first matching rule decides, else the defaults."""

    name: str
    version: str = "1"
    default_unique_threshold: int = 100
    default_action: str = "allow"
    dangerous_keys: tuple[str, ...] = ()
    rules: tuple[CardinalityRule, ...] = ()
    budgets: tuple[Budget, ...] = ()


@dataclass(frozen=True)
class Match:
    """What shaping and routing rules match on; blank and ``*`` match all."""

    name: str
    tenant: str = "*"
    source: str = "*"
    type: str = "*"
    severity: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    stop: bool = False


@dataclass(frozen=True)
class ShapingRule(Match):
    sample_rate: float | None = None
    min_sample_rate: float = 0.0
    drop_tags: tuple[str, ...] = ()
    rename_tags: dict[str, str] = field(default_factory=dict)
    payload_max_bytes: int = 0
    payload_action: str = ""
    shape_protected: bool = False


@dataclass(frozen=True)
class Protection:
    errors: bool = False
    severities: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    latency_threshold_ms: float = 0.0


@dataclass(frozen=True)
class Pressure:
    enabled: bool = False
    high_watermark: float = 0.7
    critical_watermark: float = 0.9
    high_factor: float = 0.5
    critical_factor: float = 0.25


@dataclass(frozen=True)
class ShapingConfig:
    name: str
    version: str = "1"
    default_sample_rate: float = 1.0
    protection: Protection = Protection()
    pressure: Pressure = Pressure()
    rules: tuple[ShapingRule, ...] = ()


@dataclass(frozen=True)
class Destination:
    name: str
    enabled: bool = True
    max_attempts: int = 5
    base_delay_ms: int = 500
    max_delay_ms: int = 60_000
    failure_fallback: str = ""


@dataclass(frozen=True)
class RoutingRule(Match):
    destinations: tuple[str, ...] = ()


@dataclass(frozen=True)
class RoutingConfig:
    name: str
    version: str = "1"
    destinations: tuple[Destination, ...] = ()
    rules: tuple[RoutingRule, ...] = ()
    fallback_destination: str = ""

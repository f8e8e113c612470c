"""Predicates and small functions over canonical events, as Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsflow.schema import CONTROL, Match, Policy, Protection, ShapingConfig

SEVERE = ("error", "critical", "fatal")


def tag(key: str) -> Column:
    return F.col("tags")[key]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def glob_regex(pattern: str) -> str | None:
    """A shell glob as an anchored regex; None where it matches all. ``*`` and ``?`` never match ``/``."""
    pattern = pattern.strip()
    if pattern in ("", "*"):
        return None
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{inside}]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        else:
            out.append(c if c.isalnum() or c in "_-" else "\\" + c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob(pattern: str, value: Column) -> Column:
    """Whether the value matches the glob."""
    regex = glob_regex(pattern)
    return F.lit(True) if regex is None else F.coalesce(value.rlike(regex), F.lit(False))


def is_error(trim: bool = False) -> Column:
    """Type contains ``error``, or severity or level is severe."""
    clean = (lambda c: F.trim(c)) if trim else (lambda c: c)
    severe = [F.coalesce(F.lower(clean(tag(k))).isin(*SEVERE), F.lit(False)) for k in ("severity", "level")]
    return F.coalesce(F.lower("event_type").contains("error"), F.lit(False)) | severe[0] | severe[1]


def is_latency() -> Column:
    kind = F.lower("event_type")
    return F.coalesce(F.col("metric_value").isNotNull() & (F.lower("metric_unit") == "ms") & (kind.contains("latency") | kind.contains("duration")), F.lit(False))


def high_latency(threshold: float = 1000.0) -> Column:
    return is_latency() & F.coalesce(F.col("metric_value") >= threshold, F.lit(False))


def normal_latency(threshold: float = 500.0) -> Column:
    return is_latency() & F.coalesce(F.col("metric_value") < threshold, F.lit(False))


def filled(c: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(c), F.lit(""))


def first_tag(*keys: str) -> Column:
    """The first non-blank of some tags, trimmed; null if all are blank."""
    return F.coalesce(*(filled(tag(k)) for k in keys))


def severity() -> Column:
    """Severity tag, else level, lower-cased; ``error`` where only the type says so; else empty."""
    told = F.lower(F.coalesce(filled(tag("severity")), filled(tag("level"))))
    return F.coalesce(told, F.when(F.lower("event_type").contains("error"), "error"), F.lit(""))


def rule_matches(rule: Match) -> Column:
    """Tenant, source and type globs, the severity list, and every tag glob."""
    parts = [glob(rule.tenant, F.col("tenant_id")), glob(rule.source, F.col("source")), glob(rule.type, F.col("event_type"))]
    if rule.severity:
        parts.append(severity().isin(*(s.strip().lower() for s in rule.severity)))
    parts += [tag(k).isNotNull() & glob(p, tag(k)) for k, p in rule.tags.items()]
    return all_of(parts)


_CHANGE_WORDS = ("deploy", "rollback", "release", "change")


def _changed(keys: tuple[str, ...], trim: bool) -> Column:
    kind = F.lower(F.trim("event_type")) if trim else F.lower("event_type")
    return F.coalesce(any_of([kind.contains(w) for w in _CHANGE_WORDS]), F.lit(False)) | any_of([filled(tag(k)).isNotNull() for k in keys])


def is_change(control: str = CONTROL) -> Column:
    """The predicate for change markers."""
    return _changed((control + "change_id", "change_id", "deployment_id", "rollback_of", "git_sha", "build_id", "release", "version"), trim=True)


def is_change_graph(control: str = CONTROL) -> Column:
    """The narrower predicate of the evidence graph."""
    return _changed((control + "change_id", "deployment_id", "rollback_of", "release", "version"), trim=False)


def sorted_tags(control: str | None = CONTROL) -> Column:
    """Tags as entries in key order, without control tags."""
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    if control:
        tags = F.map_filter(tags, lambda k, v: ~F.lower(k).startswith(control))
    return F.array_sort(F.map_entries(tags))


def series_id(control: str = CONTROL) -> Column:
    """``source|type|key=value...`` in key order, without control tags."""
    pairs = F.transform(sorted_tags(control), lambda e: F.concat(F.lit("|"), e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.concat("source", F.lit("|"), "event_type", F.array_join(pairs, ""))


def canonical_text(tags: Column | None = None, payload: Column | None = None) -> Column:
    """The canonical text of an event: fields in fixed order, tags in key order, nulls left out.

    ``key=value`` lines; its bytes are what sizes and costs are counted in.
    """
    entries = F.array_sort(F.map_entries(F.coalesce(F.col("tags") if tags is None else tags, F.create_map().cast("map<string,string>"))))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c, F.lit("\n"))).otherwise("")
    return F.concat(
        line("event_id", F.col("event_id")), line("tenant_id", F.col("tenant_id")), line("source", F.col("source")), line("event_type", F.col("event_type")),
        line("event_time", F.unix_micros("event_time").cast("string")),
        F.array_join(F.transform(entries, lambda e: F.concat(F.lit("tag."), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("\n"))), ""),
        line("payload", F.col("payload") if payload is None else payload), line("metric_value", F.col("metric_value").cast("decimal(28,6)").cast("string")),
        line("metric_unit", F.col("metric_unit")), line("schema_version", F.col("schema_version")), line("correlation_id", F.col("correlation_id")),
    )


def canonical_bytes(tags: Column | None = None, payload: Column | None = None) -> Column:
    return F.octet_length(canonical_text(tags, payload)).cast("long")


def is_dangerous(policy: Policy, dimension: Column) -> Column:
    """Whether a dimension's name contains one of the policy's dangerous keys."""
    return any_of([F.lower(dimension).contains(k.strip().lower()) for k in policy.dangerous_keys if k.strip()])


def slug(c: Column) -> Column:
    """Lower-case letters and digits, each other character a dash; at most 64 characters, no dash at the ends."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "-"), "^-+", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(dashed, 1, 64), "-+$", ""), F.lit("")), F.lit("unknown"))


def decision(policy: Policy, dimension: Column) -> tuple[Column, Column]:
    """Threshold and action for (source, event_type, dimension)."""
    threshold, action = F.lit(policy.default_unique_threshold).cast("long"), F.lit(policy.default_action)
    for rule in reversed(policy.rules):
        hit = glob(rule.source, F.col("source")) & glob(rule.type, F.col("event_type")) & glob(rule.dimension, dimension)
        threshold, action = F.when(hit, F.lit(rule.unique_threshold).cast("long")).otherwise(threshold), F.when(hit, rule.action).otherwise(action)
    return threshold, action


def hash64_hex(text: Column) -> Column:
    """The first eight bytes of a SHA-256 as 16 hex digits."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def hash_fraction(text: Column) -> Column:
    """The first eight bytes of a SHA-256 as a fraction of their largest value."""
    return F.conv(hash64_hex(text), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


def keep(config: ShapingConfig, rate: Column) -> Column:
    """Deterministic sampling by the event's identity."""
    without = F.concat_ws("|", F.coalesce("tenant_id", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("event_type", F.lit("")), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.coalesce("correlation_id", F.lit("")))
    identity = F.coalesce(F.nullif("event_id", F.lit("")), without)
    return F.when(rate <= 0, False).when(rate >= 1, True).otherwise(hash_fraction(F.concat(F.lit(f"{config.name}|{config.version}|"), identity)) < rate)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def effective_rate(config: ShapingConfig, base: Column, least: Column, pressure: float | Column) -> Column:
    """The rate under queue pressure, not below its floor."""
    base = clamp(base)
    least = F.least(F.greatest(least, F.lit(0.0)), base)
    if not config.pressure.enabled:
        return base
    now = clamp(pressure if isinstance(pressure, Column) else F.lit(float(pressure)))
    factor = F.when(now >= config.pressure.critical_watermark, config.pressure.critical_factor).otherwise(config.pressure.high_factor)
    return F.when(now < config.pressure.high_watermark, base).otherwise(clamp(F.greatest(base * factor, least)))


def protection(p: Protection) -> Column:
    """Why an event is protected, or null: errors, severities, types, tags, latency, in that order."""
    level = severity()
    out = F.lit(None).cast("string")
    if p.latency_threshold_ms > 0:
        out = F.when(high_latency(p.latency_threshold_ms), "high-latency telemetry")
    for key in sorted(p.tags, reverse=True):
        out = F.when(tag(key).isNotNull() & glob(p.tags[key], tag(key)), f"protected tag {key}").otherwise(out)
    for pattern in reversed(p.types):
        out = F.when(glob(pattern, F.col("event_type")), f"protected event type {pattern}").otherwise(out)
    if p.severities:
        out = F.when(level.isin(*(s.strip().lower() for s in p.severities)) & (level != ""), F.concat(F.lit("protected severity "), level)).otherwise(out)
    if p.errors:
        out = F.when(F.lower("event_type").contains("error") | level.isin(*SEVERE), "error/severe telemetry").otherwise(out)
    return out


def retry_delay_ms(attempt: Column, base: Column, most: Column) -> Column:
    """``base * 2^(attempt - 1)``, at most ``most``; unset values have floors."""
    base = F.when(base < 1, 500).otherwise(base)
    most = F.greatest(most, base)
    return F.least(base * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), most.cast("double")).cast("long")


def overlay(low: Column, high: Column) -> Column:
    """Both maps; where they share a key, the second's value."""
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def one_decimal(v: Column) -> Column:
    """A number that isn't negative with one decimal, rounded by its exact binary value, ties to even.

    Whether ``20 v`` is above an odd whole number ``m`` is asked as ``16 v - m``
    against ``-4 v``: both sides are exact where they are close, so no rounding
    of the product decides.
    """
    near = F.rint(v * 10)
    odd = lambda c: F.when(F.pmod(c, F.lit(2.0)) == 0, 0).otherwise(1)
    above, below = (16 * v - (2 * near + 1)), (16 * v - (2 * near - 1))
    up = F.when(above > -4 * v, 1).when((above == -4 * v) & (odd(near) == 1), 1).otherwise(0)
    down = F.when(below < -4 * v, 1).when((below == -4 * v) & (odd(near) == 1), 1).otherwise(0)
    return _tenths((near + up - down).cast("long"))


def _tenths(n: Column) -> Column:
    text = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), F.lit("0"))
    return F.concat(F.left(text, F.length(text) - 1), F.lit("."), F.right(text, F.lit(1)))


def duration_text(seconds: int) -> str:
    """Whole seconds as hours, minutes and seconds, leaving out leading zeros: ``45s``, ``1m0s``, ``2h0m5s``."""
    hours, rest = divmod(seconds, 3600)
    minutes, rest = divmod(rest, 60)
    return (f"{hours}h" if hours else "") + (f"{minutes}m" if hours or minutes else "") + f"{rest}s"

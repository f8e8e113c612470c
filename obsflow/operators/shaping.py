"""Adaptive shaping: sampling, protection and tag and payload rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.schema import CONTROL, ShapingConfig


def _without(key: str) -> Column:
    """The shaped tags without one key."""
    return F.map_filter("new_tags", lambda k, v: k != key)


def shape(df: DataFrame, cfg: ShapingConfig, pressure: float = 0.0, multiplier: float = 1.0, control: str = CONTROL) -> DataFrame:
    """Events with a ``decision`` struct and shaped ``new_tags`` and ``new_payload``.

    Rules are compiled to one chain of columns. They match the original event;
    the last matching rate wins; drops come before renames before the payload.
    """
    multiplier = min(max(multiplier, 0.0), 1.0)
    rows = df.withColumn("_why", X.protection(cfg.protection))
    protected = F.col("_why").isNotNull()
    stopped, rate, least = F.lit(False), F.lit(float(cfg.default_sample_rate)), F.lit(0.0)
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumns({"_stop": stopped, "_rate": rate, "_least": least, "_rules": none, "_dropped": none, "_renamed": none, "_gone": F.lit(False), "new_tags": F.coalesce("tags", F.create_map().cast("map<string,string>")), "new_payload": F.col("payload")})
    for rule in cfg.rules:
        rows = rows.withColumn("_hit", X.rule_matches(rule) & ~F.col("_stop"))
        hit = F.col("_hit")
        act = hit if rule.shape_protected else hit & ~protected
        add = lambda name, value, when: F.when(when, F.concat(F.col(name), F.array(value))).otherwise(F.col(name))
        step: dict[str, Column] = {"_rules": add("_rules", F.lit(rule.name), hit)}
        if rule.sample_rate is not None:
            step["_rate"] = F.when(hit, float(rule.sample_rate)).otherwise(F.col("_rate"))
            step["_least"] = F.when(hit, float(rule.min_sample_rate)).otherwise(F.col("_least"))
        rows = rows.withColumns(step)
        for key in rule.drop_tags:
            has = act & F.map_contains_key("new_tags", key)
            rows = rows.withColumns({"_dropped": add("_dropped", F.lit(key), has), "new_tags": F.when(has, _without(key)).otherwise(F.col("new_tags"))})
        for old in sorted(rule.rename_tags):
            new = rule.rename_tags[old]
            has = act & F.map_contains_key("new_tags", old)
            rest = _without(old)
            moved = F.when(F.map_contains_key("new_tags", new), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(new), F.col("new_tags")[old])))
            rows = rows.withColumns({"_renamed": add("_renamed", F.lit(f"{old}>{new}"), has), "new_tags": F.when(has, moved).otherwise(F.col("new_tags"))})
        if rule.payload_max_bytes > 0 and rule.payload_action == "drop":
            big = act & F.coalesce(F.octet_length("new_payload") > rule.payload_max_bytes, F.lit(False))
            mark = F.create_map(F.lit(control + "payload_oversize"), F.lit("true"))
            rows = rows.withColumn("_big", big)
            rows = rows.withColumns({"_gone": F.col("_gone") | F.col("_big"), "new_tags": F.when(F.col("_big"), X.overlay(F.col("new_tags"), mark)).otherwise(F.col("new_tags")), "new_payload": F.when(~F.col("_big"), F.col("new_payload"))}).drop("_big")
        if rule.stop:
            rows = rows.withColumn("_stop", F.col("_stop") | F.col("_hit"))
    effective = X.effective_rate(cfg, F.col("_rate"), F.col("_least"), pressure)
    if multiplier < 1:
        effective = F.when(protected, effective).otherwise(F.greatest(effective * multiplier, F.col("_least")))
    rows = rows.withColumn("_effective", effective)
    decision = F.struct(
        F.array_join("_rules", ",").alias("rules"), (protected | X.keep(cfg, F.col("_effective"))).alias("keep"), protected.alias("protected"), F.col("_why").alias("protection_reason"),
        F.col("_rate").alias("base_rate"), F.col("_effective").alias("effective_rate"), F.array_sort(F.array_distinct("_dropped")).alias("dropped_tags"),
        F.array_sort(F.array_distinct("_renamed")).alias("renamed_tags"), F.col("_gone").alias("payload_dropped"), X.canonical_bytes().alias("original_bytes"),
        X.canonical_bytes(F.col("new_tags"), F.col("new_payload")).alias("shaped_bytes"),
    )
    # One generated row keeps the chain of columns from being written out at each use of its result.
    done = F.explode(F.array(F.struct(decision.alias("decision"), "new_tags", "new_payload")))
    return rows.select(*df.columns, done.alias("_done")).select(*df.columns, "_done.decision", "_done.new_tags", "_done.new_payload")


def effects(d: Column) -> Column:
    """What a decision does, as a sorted list."""
    parts = F.concat(F.transform(d["dropped_tags"], lambda t: F.concat(F.lit("drop:"), t)), F.transform(d["renamed_tags"], lambda t: F.concat(F.lit("rename:"), t)), F.when(d["payload_dropped"], F.array(F.lit("payload_drop"))).otherwise(F.expr("cast(array() as array<string>)")))
    return F.array_sort(parts)


def shaping_diffs(df: DataFrame, active: ShapingConfig, shadow: ShapingConfig, pressure: float = 0.0) -> DataFrame:
    """Events where the shadow config keeps, samples or changes otherwise."""
    rows = shape(df, active, pressure).withColumn("_a", F.col("decision")).drop("decision", "new_tags", "new_payload")
    rows = shape(rows, shadow, pressure)
    a, s = F.col("_a"), F.col("decision")
    differ = (a["keep"] != s["keep"]) | (a["effective_rate"] != s["effective_rate"]) | (effects(a) != effects(s))
    return rows.where(differ).select("tenant_id", "event_id", a["keep"].alias("active_keep"), s["keep"].alias("shadow_keep"), a["effective_rate"].alias("active_rate"), s["effective_rate"].alias("shadow_rate"), F.array_join(effects(a), ",").alias("active_effects"), F.array_join(effects(s), ",").alias("shadow_effects"))


def _counts() -> list[Column]:
    d = F.col("decision")
    changed = (F.size(d["dropped_tags"]) > 0) | (F.size(d["renamed_tags"]) > 0) | d["payload_dropped"]
    return [
        F.count(F.lit(1)).alias("observed"), F.count_if(d["keep"]).alias("kept"), F.count_if(~d["keep"]).alias("sampled_out"), F.count_if(d["protected"]).alias("protected"),
        F.count_if(changed).alias("transformed"), F.count_if(d["payload_dropped"]).alias("payload_dropped"), F.sum(d["original_bytes"]).alias("original_bytes"), F.sum(d["shaped_bytes"]).alias("shaped_bytes"),
    ]


def shaping_minutes(shaped: DataFrame) -> DataFrame:
    """Counts of decisions by tenant, minute, rules, source and type."""
    minute = F.date_trunc("minute", "event_time").alias("minute")
    return shaped.groupBy("tenant_id", minute, F.col("decision.rules").alias("rules"), "source", "event_type").agg(*_counts())


def shaping_summary(minutes: DataFrame, since) -> DataFrame:
    """Totals of each tenant's minutes since a time."""
    names = ("observed", "kept", "sampled_out", "protected", "transformed", "payload_dropped", "original_bytes", "shaped_bytes")
    return minutes.where(F.col("minute") >= F.lit(since).cast("timestamp")).groupBy("tenant_id").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))


def shaping_preview(df: DataFrame, cfg: ShapingConfig, pressure: float, by: list[str]) -> DataFrame:
    """Counts and retention of each group under a config; nothing protected counts as all kept."""
    d = F.col("decision")
    kind = F.struct("source", "event_type")
    rows = shape(df, cfg, pressure).groupBy(*by).agg(*_counts(), F.count_if(d["protected"] & d["keep"]).alias("protected_kept"), F.count_distinct(kind).alias("kinds"), F.count_distinct(F.when(d["keep"], kind)).alias("kinds_kept"))
    share = lambda a, b: F.when(F.col(b) == 0, 100.0).otherwise(F.col(a) * 100.0 / F.col(b))
    return rows.withColumns({"event_retention": share("kept", "observed"), "byte_retention": F.when(F.col("original_bytes") > 0, F.col("shaped_bytes") * 100.0 / F.col("original_bytes")).otherwise(0.0), "protected_retention": share("protected_kept", "protected"), "coverage": share("kinds_kept", "kinds")})

"""Filters, listings, appends and merges of event and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the others with the first ``reason``."""
    blank = lambda c: X.filled(F.col(c)).isNull()
    metric = F.col("metric_unit").isNotNull() & F.col("metric_value").isNull()
    reason = F.when(blank("source"), "source is required").when(blank("event_type"), "type is required").when(F.col("event_time").isNull(), "timestamp is required").when(blank("schema_version"), "schema_version is required").when(metric, "metric value is required")
    rows = df.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def normalize(df: DataFrame) -> DataFrame:
    """Trimmed source and type; ``failed`` where one is empty."""
    rows = df.withColumn("source", F.trim("source")).withColumn("event_type", F.trim("event_type"))
    return rows.withColumn("failed", X.filled(F.col("source")).isNull() | X.filled(F.col("event_type")).isNull())


def for_tenant(df: DataFrame, tenant: str = "default") -> DataFrame:
    return df.where(F.coalesce(X.filled(F.col("tenant_id")), F.lit("default")) == (tenant or "default"))


def redact(df: DataFrame, keys: tuple[str, ...], payload: bool = False) -> DataFrame:
    """Listed tags (in any case) and, if asked, payloads hidden."""
    hidden = [k.lower() for k in keys]
    rows = df.withColumn("tags", F.transform_values("tags", lambda k, v: F.when(F.lower(k).isin(hidden), "[REDACTED]").otherwise(v)))
    return rows.withColumn("payload", F.when(F.col("payload").isNotNull(), '{"redacted":true}')) if payload else rows


def search_events(df: DataFrame, tenant: str, source: str | None = None, type: str | None = None, t0=None, t1=None, metrics_only: bool = False, limit: int = 100) -> DataFrame:
    """A tenant's newest events under optional filters, at most 1,000."""
    rows = for_tenant(df, tenant)
    if source:
        rows = rows.where(F.col("source") == source)
    if type:
        rows = rows.where(F.col("event_type") == type)
    if t0 is not None:
        rows = rows.where(F.col("event_time") >= F.lit(t0).cast("timestamp"))
    if t1 is not None:
        rows = rows.where(F.col("event_time") <= F.lit(t1).cast("timestamp"))
    if metrics_only:
        rows = rows.where("metric_value is not null")
    return rows.orderBy(F.col("event_time").desc(), F.col("event_id").desc()).limit(max(1, min(limit, 1000)))


def live_page(df: DataFrame, tenant: str, after_ts, after_id: str, limit: int, time: str = "ingested_at") -> DataFrame:
    """The next events by (ingestion time, id) after a cursor."""
    at = F.lit(after_ts).cast("timestamp")
    later = (F.col(time) > at) | ((F.col(time) == at) & (F.col("event_id") > after_id))
    return for_tenant(df, tenant).where(later).orderBy(time, "event_id").limit(limit)


def newest(df: DataFrame, time: str, k: int, per: list[str], tie: str) -> DataFrame:
    """The ``k`` newest rows of each group."""
    w = W.partitionBy(*per).orderBy(F.col(time).desc(), F.col(tie).desc())
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def earliest_capture(captures: DataFrame) -> DataFrame:
    """The earliest capture of each event."""
    return first_by(captures, ["tenant_id", "event_id"], ["captured_at"])


def insert_absent(new: DataFrame, old: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The old rows and those new rows whose key isn't there; of several new rows the first."""
    return old.unionByName(first_by(new.join(old.select(*keys), keys, "left_anti"), keys, order))


def append_dedup(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Events to append: the first of each (tenant, event) that isn't stored."""
    return first_by(new.join(existing.select("tenant_id", "event_id"), ["tenant_id", "event_id"], "left_anti"), ["tenant_id", "event_id"], ["event_time", "n"] if "n" in new.columns else ["event_time"])


def upsert(new: DataFrame, old: DataFrame, keys: list[str], order: str, spec: dict[str, str]) -> DataFrame:
    """Merge rows by key. Per column: ``last`` writer, last non-null (``coalesce``), ``first``, or ``add``."""
    rows = old.unionByName(new)
    seen = F.col(order)
    made: list[Column] = []
    for name, how in spec.items():
        c = F.col(name)
        made.append({
            "last": F.max_by(c, seen), "first": F.min_by(c, seen), "add": F.sum(c),
            "coalesce": F.max_by(c, F.when(c.isNotNull(), seen)),
        }[how].alias(name))
    return rows.groupBy(*keys).agg(*made)


def prune(df: DataFrame, time: str, cutoff, tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and how many each tenant loses."""
    old = F.col(time) < F.lit(cutoff).cast("timestamp")
    if tenant:
        old = old & (F.col("tenant_id") == tenant)
    return df.where(~F.coalesce(old, F.lit(False))), df.where(old).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_removed"))


def union_names(*dfs: DataFrame) -> DataFrame:
    """The distinct names of several one-column tables."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.union(df)
    return out.distinct()


def set_changes(a: Column, b: Column) -> tuple[Column, Column]:
    """What the second array adds to the first, and what it lacks; both sorted."""
    return F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))


def same_effects(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def jaccard(left: DataFrame, right: DataFrame, by_left: list[str], by_right: list[str], feature: str) -> DataFrame:
    """Shared features and Jaccard similarity of all pairs of sets that share one, by an inverted index."""
    left, right = left.select(*by_left, feature).distinct(), right.select(*by_right, feature).distinct()
    shared = left.join(right, feature).groupBy(*by_left, *by_right).agg(F.count(F.lit(1)).alias("shared"))
    shared = shared.join(left.groupBy(*by_left).agg(F.count(F.lit(1)).alias("_l")), by_left).join(right.groupBy(*by_right).agg(F.count(F.lit(1)).alias("_r")), by_right)
    return shared.withColumn("jaccard", F.col("shared") / (F.col("_l") + F.col("_r") - F.col("shared"))).drop("_l", "_r")

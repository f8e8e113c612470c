"""Summaries of events by window, source and tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.operators import quantiles


def p95(cond: Column, value: str = "metric_value", approximate: int | None = None) -> Column:
    """The interpolated 95th percentile of the values under a condition; 0 without any."""
    chosen = F.when(cond, F.col(value))
    found = F.percentile_approx(chosen, 0.95, approximate) if approximate else F.percentile(chosen, 0.95)
    return F.coalesce(found.cast("double"), F.lit(0.0))


def exact_p95(df: DataFrame, by: list[str], aggs: list[Column], conditions: dict[str, Column], value: str = "metric_value", most: int | None = None) -> DataFrame:
    """``aggs`` of each group with exact 95th percentiles under conditions, also of groups with very many values; 0 without any.

    ``most``: a bound on the values of a group, where it is known.
    """
    rows = quantiles.aggregate(df, by, aggs, {name: F.when(cond, F.col(value)) for name, cond in conditions.items()}, most=most)
    return rows.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in conditions})


def window_stats(df: DataFrame, by: list[str], approximate: int | None = None) -> DataFrame:
    """events, errors, error_rate and p95_ms of each group."""
    aggs = [F.count(F.lit(1)).alias("events"), F.count_if(X.is_error()).alias("errors")]
    if approximate:
        rows = df.groupBy(*by).agg(*aggs, p95(X.is_latency(), approximate=approximate).alias("p95_ms"))
    else:
        rows = exact_p95(df, by, aggs, {"p95_ms": X.is_latency()})
    return rows.withColumn("error_rate", F.col("errors") / F.col("events"))


def summary(df: DataFrame, now, seconds: int, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Operations summary of the window that ends at ``now``."""
    end = F.lit(now).cast("timestamp")
    rows = df.where((F.col("event_time") >= end - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("event_time") <= end))
    aggs = [F.count(F.lit(1)).alias("events"), F.count_distinct("source").alias("sources"), F.count_if(X.is_error()).alias("errors")]
    out = exact_p95(rows, list(by), aggs, {"p95_ms": X.is_latency()})
    return out.withColumn("events_per_second", F.col("events") / seconds).withColumn("error_rate", F.col("errors") / F.col("events"))


#: Windows in a slice of time.
SLICE = 16


def sliding_error_count(df: DataFrame, seconds: int = 60, latency_threshold: float = 1000.0) -> DataFrame:
    """Adds ``recent_errors``: errors of the same tenant and source in the last ``seconds`` (its start exclusive) that breach no latency.

    A source is cut into slices of ``SLICE`` windows. The errors of a slice's last
    window also stand before the next slice, so each is counted by itself.
    """
    width = seconds * 1_000_000
    piece = SLICE * width
    counts = X.is_error() & ~X.high_latency(latency_threshold)
    rows = df.withColumn("_us", F.unix_micros("event_time")).withColumn("_slice", F.floor(F.col("_us") / piece))
    late = counts & (F.col("_us") - F.col("_slice") * piece > piece - width)
    rows = rows.withColumn("_in", F.explode(F.when(late, F.array(F.col("_slice"), F.col("_slice") + 1)).otherwise(F.array("_slice"))))
    w = W.partitionBy("tenant_id", "source", "_in").orderBy("_us").rangeBetween(-(width - 1), 0)
    return rows.withColumn("recent_errors", F.count(F.when(counts, 1)).over(w)).where("_in = _slice").drop("_us", "_slice", "_in")


def counter_delta(df: DataFrame, keys: list[str], total: str, time: str) -> DataFrame:
    """Increases of a cumulative counter; a fall is a reset to zero; zero increases are dropped."""
    last = F.coalesce(F.lag(total).over(W.partitionBy(*keys).orderBy(time)), F.lit(0))
    rows = df.withColumn("delta", F.when(F.col(total) < last, F.col(total)).otherwise(F.col(total) - last))
    return rows.where("delta > 0")


def forecast_pressure(df: DataFrame, keys: list[str], samples: int = 12, horizon: float = 30.0) -> DataFrame:
    """Least-squares forecast of the pressure ``horizon`` seconds ahead, its confidence and the rate multiplier it asks for."""
    w = W.partitionBy(*keys).orderBy("at").rowsBetween(-(samples - 1), 0)
    x, y = F.unix_micros("at") / 1e6, X.clamp(F.col("queue_pressure"))
    # Times count from the frame's own start, so that squares stay exact.
    frame = df.withColumn("_points", F.collect_list(F.struct(x.alias("x"), y.alias("y"))).over(w))
    total = lambda f: F.aggregate("_points", F.lit(0.0), lambda a, p: a + f(p["x"] - F.col("_points")[0]["x"], p["y"]))
    n = F.size("_points")
    sx, sy, sxy, sxx = (total(f) for f in (lambda u, v: u, lambda u, v: v, lambda u, v: u * v, lambda u, v: u * u))
    below = n * sxx - sx * sx
    rows = frame.withColumn("samples", n.cast("long")).withColumn("slope", F.when(F.abs(below) < 1e-12, 0.0).otherwise((n * sxy - sx * sy) / below))
    rows = rows.withColumn("projected", X.clamp(y + F.col("slope") * horizon))
    rows = rows.withColumn("confidence", F.when(n >= 8, "high").when(n >= 4, "medium").when((n >= 2) & (F.abs(below) >= 1e-12), "low").otherwise("insufficient"))
    ask = F.when(F.col("projected") >= 0.95, 0.50).when(F.col("projected") >= 0.90, 0.60).when(F.col("projected") >= 0.82, 0.75).otherwise(1.0)
    return rows.withColumn("multiplier", ask).drop("_points")

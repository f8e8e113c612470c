"""Cardinality of tags by hour, the cardinality firewall and series budgets.

Counts are exact up to 16 distinct values of a key in an hour; beyond that they
are the estimate of a 64-register HyperLogLog. Running counts follow
(event_time, event_id) inside each hourly key. A key's hour is one window's
work up to ``HOT`` events, and beyond that is cut into slices of time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.schema import CONTROL, Policy

REGISTERS, EXACT, ALPHA = 64, 16, 0.709
KEY = ["tenant_id", "source", "event_type", "dimension", "hour"]
ORDER = ["event_time", "event_id"]


def registers(value: Column) -> tuple[Column, Column]:
    """Register and rank of a value: the low six bits of its hash, and the zeros below the rest's lowest one bit."""
    return _register(_hash(value))


def _hash(value: Column) -> Column:
    return F.conv(X.hash64_hex(value), 16, -10).cast("long")


def _register(h: Column) -> tuple[Column, Column]:
    rest = F.shiftrightunsigned(h, 6)
    low = rest.bitwiseAND(F.try_subtract(F.bitwise_not(rest), F.lit(-1)))  # rest & -rest
    zeros = F.when(rest == 0, 58).otherwise(F.bit_count(low - 1))
    return h.bitwiseAND(F.lit(REGISTERS - 1).cast("long")).cast("int"), F.least(zeros + 1, F.lit(59)).cast("int")


def estimate(inverse_sum: Column, zeros: Column) -> Column:
    """The estimate from the sum of 2^-rank over all registers and the number of empty ones."""
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / inverse_sum
    small = (raw <= 2.5 * REGISTERS) & (zeros > 0)
    raw = F.when(small, REGISTERS * F.ln(REGISTERS / F.greatest(zeros, F.lit(1)))).otherwise(raw)
    return F.greatest(F.round(raw), F.lit(1.0)).cast("long")


def tag_rows(df: DataFrame) -> DataFrame:
    """A row for each tag of each event, with the hour of its time."""
    return df.select("tenant_id", "source", "event_type", "event_id", "event_time", F.date_trunc("hour", "event_time").alias("hour"), F.explode("tags").alias("dimension", "value"))


def cardinality_hourly(rows: DataFrame, keys: list[str] = KEY, tracker: str = "registers") -> DataFrame:
    """State of each hourly key: observed, samples, first and last seen.

    ``tracker`` is how values are counted: ``registers`` as above, ``exact``, or
    ``sketch``, Spark's own HyperLogLog. All combine before they shuffle.

    With registers: two aggregations: the largest rank of each register, then the estimate;
    both combine before they shuffle.
    """
    span = (F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    if tracker == "sketch":
        return rows.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg("value")).alias("observed"), F.count(F.lit(1)).alias("samples"), *span)
    if tracker == "exact":
        values = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("a"), F.max("event_time").alias("b"))
        return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"), F.sum("n").alias("samples"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    if tracker != "registers":
        raise ValueError(f"no tracker {tracker}")
    idx, rank = registers(F.col("value"))
    cells = rows.select(*keys, idx.alias("idx"), rank.alias("rank"), "value", "event_time").groupBy(*keys, "idx", "rank", "value").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    by_register = cells.groupBy(*keys, "idx").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    out = by_register.groupBy(*keys).agg(
        F.sum("values").alias("distinct_values"), F.sum("n").alias("samples"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
        F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_s"), F.count(F.lit(1)).alias("_used"),
    )
    guess = estimate(F.col("_s") + (REGISTERS - F.col("_used")), REGISTERS - F.col("_used"))
    return out.withColumn("observed", F.when(F.col("distinct_values") <= EXACT, F.col("distinct_values")).otherwise(guess)).drop("_s", "_used", "distinct_values")


def sketch(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The mergeable state of each key, one row of some 200 bytes however many values it saw.

    ``registers`` are the largest ranks, a byte each; ``hashes`` those of the distinct
    values while there are at most EXACT, and empty with ``overflow`` beyond.
    """
    # Values are told apart and numbered by hash, so a key's hashes and registers come from one pass, and a register is a row.
    cells = rows.select(*keys, _hash(F.col("value")).alias("hash")).distinct()
    cells = cells.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_last("hash"))))
    idx, rank = _register(F.col("hash"))
    few = F.collect_list(F.when(F.col("_k") <= EXACT + 1, F.col("hash")))  # of a key no more than one beyond EXACT are gathered
    of = cells.groupBy(*keys, idx.alias("idx")).agg(F.max(rank).alias("rank"), few.alias("few"))
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", "rank"))
    out = of.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_ranks"), F.flatten(F.collect_list("few")).alias("hashes"))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), lambda i: F.coalesce(F.element_at("_ranks", i), F.lit(0)))
    return _state(out.withColumn("_ranks", ranks).withColumn("overflow", F.lit(False)), keys)


def merge_sketches(states: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One state of each key from all of its ``states``, in any order and grouping; a key's states meet in one row."""
    out = states.groupBy(*keys).agg(F.collect_list("registers").alias("_all"), F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"), F.max("overflow").alias("overflow"))
    larger = lambda a, r: F.zip_with(a, _ranks(r), lambda x, y: F.greatest(x, y))
    return _state(out.withColumn("_ranks", F.aggregate("_all", F.array_repeat(F.lit(0), REGISTERS), larger)), keys)


def _ranks(packed: Column) -> Column:
    """The ranks of a state's registers; all are below 128, so bytes are characters."""
    return F.transform(F.split(packed.cast("string"), ""), lambda c: F.ascii(c))


def _state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """States of (ranks, hashes, overflow): a byte for each rank, and no hashes if there are more than EXACT."""
    packed = F.unhex(F.array_join(F.transform("_ranks", lambda r: F.lpad(F.hex(r), 2, "0")), ""))
    over = F.col("overflow") | (F.size("hashes") > EXACT)
    none = F.expr("cast(array() as array<bigint>)")
    return rows.select(*keys, packed.alias("registers"), F.when(over, none).otherwise(F.sort_array("hashes")).alias("hashes"), over.alias("overflow"))


def sketched(states: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The number of distinct values of each key's state: exact without overflow, else the estimate."""
    rows = states.withColumn("_ranks", _ranks(F.col("registers")))
    total = F.aggregate("_ranks", F.lit(0.0), lambda a, r: a + F.pow(F.lit(2.0), -r))
    guess = estimate(total, F.size(F.filter("_ranks", lambda r: r == 0)))
    return rows.select(*keys, F.when(F.col("overflow"), guess).otherwise(F.size("hashes").cast("long")).alias("observed"))


def merge_cardinality(a: DataFrame, b: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Distinct values of each key over two sketches."""
    return sketched(merge_sketches(a.unionByName(b), keys), keys)


def project(observed: Column, samples: Column, first_seen: Column, now: Column) -> Column:
    """Distinct values after a full hour at the present pace, where enough was seen."""
    elapsed = (F.unix_micros(now) - F.unix_micros(first_seen)) / 1e6
    fit = (elapsed >= 30) & (elapsed < 3600) & (samples >= 10)
    return F.when(fit, F.greatest(F.ceil(observed * F.lit(3600.0) / elapsed), observed)).otherwise(observed).cast("long")


def running_distinct(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``exact``: distinct values of the key up to and with each event."""
    so_far = W.partitionBy(*keys).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    return _firsts(rows, keys, value).withColumn("exact", F.sum("_first").over(so_far)).drop("_first")


def _firsts(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds _first: 1 where a value of the key comes for the first time."""
    return rows.withColumn("_first", (F.row_number().over(W.partitionBy(*keys, value).orderBy(*ORDER)) == 1).cast("int"))


def running_hll(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``sketched``: the estimate after each event.

    A register changes where an event's rank passes all before it. The change
    of its term telescopes, so the sums over all registers are running sums.
    """
    return _sketched_so_far(_changes(rows, keys, value), keys)


def _changes(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds _ds and _dz: how an event changes the sum over the registers and the number of empty ones."""
    idx, rank = registers(F.col(value))
    rows = rows.withColumn("_idx", idx).withColumn("_rank", rank)
    before = F.coalesce(F.max("_rank").over(W.partitionBy(*keys, "_idx").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before)
    up = F.col("_rank") > F.col("_before")
    rows = rows.withColumn("_ds", F.when(up, F.pow(F.lit(2.0), -F.col("_rank")) - F.pow(F.lit(2.0), -F.col("_before"))).otherwise(0.0)).withColumn("_dz", F.when(up & (F.col("_before") == 0), 1).otherwise(0))
    return rows.drop("_idx", "_rank", "_before")


def _sketched_so_far(rows: DataFrame, keys: list[str]) -> DataFrame:
    so_far = W.partitionBy(*keys).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_s", REGISTERS + F.sum("_ds").over(so_far)).withColumn("_z", REGISTERS - F.sum("_dz").over(so_far))
    return rows.withColumn("sketched", estimate(F.col("_s"), F.col("_z"))).drop("_ds", "_dz", "_s", "_z")


def observe(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Adds observed and projected after each event."""
    return _judged(_running(rows, keys))


def _running(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds exact, sketched, and how many events of the key there were and since when."""
    so_far = W.partitionBy(*keys).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    # Marks first, so that all sums are over one order.
    rows = _changes(_firsts(rows, keys), keys)
    rows = _sketched_so_far(rows.withColumn("exact", F.sum("_first").over(so_far)).drop("_first"), keys)
    return rows.withColumn("_samples", F.count(F.lit(1)).over(so_far)).withColumn("_since", F.min("event_time").over(so_far))


def _judged(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("observed", F.when(F.col("exact") <= EXACT, F.col("exact")).otherwise(F.col("sketched")))
    rows = rows.withColumn("projected", project(F.col("observed"), F.col("_samples"), F.col("_since"), F.col("event_time")))
    return rows.drop("exact", "sketched", "_samples", "_since")


#: Events of a (tenant, source, type, hour) beyond which its keys are counted in slices of time; and seconds of a slice.
HOT, SLICE = 1_000_000, 1
#: Events whose tags are one task's.
DEALT = 25_000


def observe_sliced(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """What :func:`observe` adds, for keys with many events in an hour."""
    return _judged(_running_sliced(rows, keys))


def _running_sliced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What :func:`_running` adds, by slices of time.

    Every running figure is its value at the begin of a slice of time and what
    the slice adds. What a slice begins with comes from tables by key and slice,
    so no task needs more than the rows of a slice and the list of slices.
    """
    idx, rank = registers(F.col("value"))
    rows = rows.withColumn("_slice", F.floor(F.unix_micros("event_time") / (SLICE * 1_000_000))).withColumn("_idx", idx).withColumn("_rank", rank)
    earlier = lambda *by: W.partitionBy(*keys, *by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    inside = lambda *by: W.partitionBy(*keys, *by, "_slice").orderBy(*ORDER)
    # A value counts once: at its first row of the first slice that has it.
    seen = rows.select(*keys, "value", "_slice").distinct().withColumn("_known", F.count(F.lit(1)).over(earlier("value")) > 0)
    # A register's largest rank before a slice.
    ranks = rows.groupBy(*keys, "_idx", "_slice").agg(F.max("_rank").alias("_m")).withColumn("_carried", F.coalesce(F.max("_m").over(earlier("_idx")), F.lit(0))).drop("_m")
    rows = rows.withColumn("_again", F.row_number().over(inside("value"))).join(seen, [*keys, "value", "_slice"])
    rows = rows.withColumn("_first", ((F.col("_again") == 1) & ~F.col("_known")).cast("int"))
    before = F.coalesce(F.max("_rank").over(inside("_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).join(ranks, [*keys, "_idx", "_slice"]).withColumn("_before", F.greatest("_before", "_carried"))
    up = F.col("_rank") > F.col("_before")
    rows = rows.withColumn("_ds", F.when(up, F.pow(F.lit(2.0), -F.col("_rank")) - F.pow(F.lit(2.0), -F.col("_before"))).otherwise(0.0)).withColumn("_dz", F.when(up & (F.col("_before") == 0), 1).otherwise(0))
    sums = ("_first", "_ds", "_dz", "_one")
    rows = rows.withColumn("_one", F.lit(1)).drop("_again", "_known", "_before", "_carried", "_idx", "_rank")
    starts = rows.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(f"{c}_n") for c in sums), F.min("event_time").alias("_t"))
    starts = starts.select(*keys, "_slice", *(F.coalesce(F.sum(f"{c}_n").over(earlier()), F.lit(0)).alias(f"{c}_s") for c in sums), F.min("_t").over(W.partitionBy(*keys)).alias("_since"))
    so_far = inside().rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"{c}_i": F.sum(c).over(so_far) for c in sums}).join(starts, [*keys, "_slice"])
    of = lambda c: F.col(f"{c}_s") + F.col(f"{c}_i")
    rows = rows.withColumns({"exact": of("_first"), "sketched": estimate(REGISTERS + of("_ds"), REGISTERS - of("_dz")), "_samples": of("_one")})
    return rows.drop("_slice", *sums, *(f"{c}_{x}" for c in sums for x in "is"))


def observed(df: DataFrame) -> DataFrame:
    """Tag rows with observed and projected; hours with many events of one kind are counted in slices."""
    return _judged(_counted(df))


def running(df: DataFrame) -> DataFrame:
    """Tag rows with ``exact`` and ``sketched``, the distinct values of their hourly key up to and with each event.

    As :func:`running_distinct` and :func:`running_hll`, with hours of many events in slices.
    """
    return _counted(df).drop("_samples", "_since")


def _counted(df: DataFrame) -> DataFrame:
    hour = [*KEY[:3], F.date_trunc("hour", "event_time").alias("hour")]
    # An event has each dimension once, so no key has more rows than its hour has events.
    sizes = df.groupBy(*hour).count()
    total, most = sizes.agg(F.sum("count"), F.max("count")).collect()[0]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / DEALT))
    # Tags are dealt by key once, to tasks of bounded size; every window's keys hold the hourly key, so none deals them again.
    counted = lambda df: _running(tag_rows(df).repartition(n, *KEY), KEY)
    if (most or 0) <= HOT:
        return counted(df)
    hot = sizes.where(F.col("count") > HOT).select(*KEY[:3], "hour")
    on = [*KEY[:3], "hour"]
    marked = df.withColumn("hour", F.date_trunc("hour", "event_time"))
    cool, rest = (marked.join(hot, on, how).select(*df.columns) for how in ("left_anti", "left_semi"))
    return counted(cool).unionByName(_running_sliced(tag_rows(rest), KEY))


def decisions(df: DataFrame, policy: Policy) -> DataFrame:
    """For each event and tag: threshold, observed, projected, and ``act`` (null without a finding)."""
    rows = observed(df)
    threshold, action = X.decision(policy, F.col("dimension"))
    rows = rows.withColumn("threshold", threshold).withColumn("_act", action)
    crossed = (F.col("observed") >= F.col("threshold")) | (F.col("projected") >= F.col("threshold"))
    early = X.is_dangerous(policy, F.col("dimension")) & (F.col("observed") >= F.greatest(F.lit(3), F.floor(F.col("threshold") / 10))) & ~crossed
    said = F.when(crossed, F.format_string("estimated cardinality %d (projected %d) meets policy threshold %d", "observed", "projected", "threshold"))
    said = said.when(early, F.format_string("identifier-shaped dimension warning: estimated cardinality %d is approaching threshold %d", "observed", "threshold"))
    return rows.withColumn("act", F.when(crossed, F.col("_act")).when(early, "allow")).withColumn("reason", said).drop("_act")


def apply_policy(df: DataFrame, policy: Policy, control: str = CONTROL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with their tags under the policy, the findings, and the quarantined originals with joined reasons."""
    found = decisions(df, policy).where("act is not null")
    lost = found.where("act in ('drop_tag', 'quarantine')").groupBy("tenant_id", "event_id").agg(
        F.collect_set("dimension").alias("_lost"),
        F.array_sort(F.collect_list(F.when(F.col("act") == "quarantine", F.struct("dimension", "reason")))).alias("_held"),
    )
    rows = df.join(lost, ["tenant_id", "event_id"], "left")
    kept = F.map_filter("tags", lambda k, v: ~F.coalesce(F.array_contains(F.col("_lost"), k), F.lit(False)))
    marks = F.create_map(F.lit(control + "quarantined"), F.lit("true"), F.lit(control + "quarantine_dimensions"), F.array_join(F.transform("_held", lambda h: h["dimension"]), ","))
    held = F.coalesce(F.size("_held"), F.lit(0)) > 0
    out = rows.withColumn("tags", F.when(held, X.overlay(kept, marks)).otherwise(kept)).drop("_lost", "_held")
    quarantined = rows.where(held).withColumn("reason", F.array_join(F.transform("_held", lambda h: h["reason"]), "; ")).drop("_lost", "_held")
    return out, found, quarantined


def policy_diffs(df: DataFrame, active: Policy, shadow: Policy) -> DataFrame:
    """(event, dimension) where the shadow policy would act otherwise; a tag without a finding is allowed."""
    # Both policies see the same events, so one pass over the counts serves both.
    rows = decisions(df, active).withColumn("active_action", F.coalesce("act", F.lit("allow"))).drop("act", "reason", "threshold")
    threshold, action = X.decision(shadow, F.col("dimension"))
    crossed = (F.col("observed") >= threshold) | (F.col("projected") >= threshold)
    rows = rows.withColumn("shadow_action", F.when(crossed, action).otherwise("allow"))
    return rows.where("active_action != shadow_action").select("tenant_id", "event_id", "source", "event_type", "dimension", "active_action", "shadow_action")


def match_budgets(df: DataFrame, policy: Policy) -> DataFrame:
    """A row for each event and budget that it counts for."""
    hits = [F.when(X.glob(b.source, F.col("source")) & X.glob(b.type, F.col("event_type")), F.struct(F.lit(b.name).alias("budget"), F.lit(b.series_limit).alias("series_limit"), F.lit(b.warning_percent).alias("warning"), F.lit(b.critical_percent).alias("critical"))) for b in policy.budgets]
    return df.withColumn("_b", F.explode(F.array_compact(F.array(*hits)))).select("*", "_b.*").drop("_b")


def budget_status(df: DataFrame, policy: Policy) -> DataFrame:
    """Hourly distinct series against each budget, at the hour's last event."""
    keys = ["tenant_id", "budget", "hour"]
    rows = match_budgets(df, policy).withColumn("value", X.series_id()).withColumn("hour", F.date_trunc("hour", "event_time"))
    limits = reduce(lambda a, b: a.union(b), [df.sparkSession.range(1).select(F.lit(b.name).alias("budget"), F.lit(b.series_limit).alias("series_limit"), F.lit(b.warning_percent).alias("warning"), F.lit(b.critical_percent).alias("critical")) for b in policy.budgets])
    out = cardinality_hourly(rows, keys).join(F.broadcast(limits), "budget")  # one row for each budget of the policy
    out = out.withColumn("projected", project(F.col("observed"), F.col("samples"), F.col("first_seen"), F.col("last_seen")))
    percent = 100.0 * F.greatest("observed", "projected") / F.col("series_limit")
    status = F.when(percent >= 100, "exceeded").when(percent >= F.col("critical"), "critical").when(percent >= F.col("warning"), "warning").otherwise("healthy")
    return out.withColumn("consumption_percent", percent).withColumn("status", status).drop("warning", "critical")


def top_dimensions(states: DataFrame, k: int) -> DataFrame:
    """States that grow most: by projected less observed, then projected; budgets' own keys are hidden."""
    return states.where(~F.col("dimension").startswith("__")).orderBy((F.col("projected") - F.col("observed")).desc(), F.col("projected").desc(), *KEY).limit(k)


def top_budgets(status: DataFrame, since, k: int) -> DataFrame:
    """The worst budgets of the last hours: by status, share and time."""
    rank = F.array_position(F.array(*map(F.lit, ("healthy", "warning", "critical", "exceeded"))), F.col("status"))
    return status.where(F.col("last_seen") >= F.lit(since).cast("timestamp")).orderBy(rank.desc(), F.col("consumption_percent").desc(), F.col("last_seen").desc(), "tenant_id", "budget").limit(k)

"""Exact percentiles of groups of any size, by distributed selection.

Spark's ``percentile`` keeps all distinct values of a group in one buffer. That is
right for small groups. In larger ones the two order statistics are selected:
a histogram over each group's range of values tells in which bins the wanted
ranks lie, and only the values of those bins go on to a finer histogram, until a
bin is small or holds one value. A group is never gathered; tasks count values
by bin, combined before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.staging import stage

#: Values of a group up to which one task takes them in one buffer.
BUFFERED = 1_000_000
#: Bins of a histogram, and groups up to which their ranges are broadcast.
BINS, FEW = 4096, 100_000
#: More than the powers of two that doubles have.
POWERS = 5000


def aggregate(rows: DataFrame, by: list[str], aggs: list[Column], values: dict[str, Column], q: float = 0.95, buffered: int = BUFFERED, most: int | None = None) -> DataFrame:
    """``aggs`` of each group, and for each of ``values`` the interpolated percentile under its name (null if none).

    ``most`` bounds the values of a group; they are counted where it isn't given.
    """
    small = rows.groupBy(*by).agg(*aggs, *(F.percentile(v.cast("double"), q).alias(name) for name, v in values.items()))
    if most is None and not rows.isStreaming:
        counts = rows.groupBy(*by).agg(*(F.count(v).alias(f"_{i}") for i, v in enumerate(values.values())))
        most = max(n or 0 for n in counts.agg(*(F.max(f"_{i}") for i in range(len(values)))).collect()[0])
    if rows.isStreaming or most <= buffered:
        return small
    out = rows.groupBy(*by).agg(*aggs, F.struct(*by).alias("_group"))
    for name, v in values.items():
        found = percentile(rows.select(F.struct(*by).alias("_group"), v.cast("double").alias("_value")), q, buffered)
        out = out.join(found.withColumnRenamed("_percentile", name), "_group", "left")
    return out.drop("_group")


def percentile(values: DataFrame, q: float, buffered: int = BUFFERED) -> DataFrame:
    """(_group, _percentile) of (_group, _value): the values at the two ranks around ``q``, and between them."""
    values = values.where("_value is not null")
    finite = F.when(~F.isnan("_value") & (F.abs("_value") < float("inf")), F.col("_value"))
    groups = stage(values.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")), "quantile-groups")
    place = (F.col("_n") - 1) * F.lit(float(q))
    # The first histogram serves both ranks of a group; later ones belong to one rank.
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("_which"), f(place).cast("long").alias("_rank")) for i, f in enumerate((F.floor, F.ceil)))))
    wanted = groups.select("_group", ranks.alias("_r")).select("_group", "_r.*")
    picked = _pick(_histogram(values, groups, ["_group"]), wanted, ["_group"])
    done = picked.where("_least <=> _most")
    results = [done.select("_group", "_which", F.col("_least").alias("_at"))]
    picked = stage(picked.where("not (_least <=> _most)"), "quantile-picked")
    key = ["_group", "_which"]
    left = stage(_within(values, picked, ["_group"]), "quantile-values")
    while picked.where(F.col("_held") > buffered).limit(1).count():
        ranges = picked.select(*key, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"))
        wanted = picked.select(*key, "_rank")
        finer = _pick(_histogram(left, ranges, key), wanted, key)
        results.append(finer.where("_least <=> _most").select(*key, F.col("_least").alias("_at")))
        picked = stage(finer.where("not (_least <=> _most)"), "quantile-picked")
        left = stage(_within(left, picked, key), "quantile-values")
    lists = left.groupBy(*key).agg(F.sort_array(F.collect_list("_value")).alias("_sorted")).join(picked.select(*key, "_rank"), key)
    results.append(lists.select(*key, F.element_at("_sorted", (F.col("_rank") + 1).cast("int")).alias("_at")))
    ends = results[0]
    for more in results[1:]:
        ends = ends.unionByName(more)
    of = lambda which: F.max(F.when(F.col("_which") == which, F.col("_at")))
    ends = ends.groupBy("_group").agg(of(0).alias("_low"), of(1).alias("_high")).join(groups.select("_group", place.alias("_place")), "_group")
    between = (F.ceil("_place") - F.col("_place")) * F.col("_low") + (F.col("_place") - F.floor("_place")) * F.col("_high")
    return ends.select("_group", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("_percentile"))


def _few(ranges: DataFrame) -> DataFrame:
    """The ranges, broadcast while they are few."""
    return F.broadcast(ranges) if ranges.limit(FEW + 1).count() <= FEW else ranges


def _histogram(values: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """Bins of each range (_lo to _hi): how many values, the least and the most of them.

    A range over several powers of two has a bin for each power and sign, so one
    round takes any range to one power; others have equal bins. Infinities and
    not-a-number have bins of their own.
    """
    v, lo, hi = F.col("_value"), F.col("_lo"), F.col("_hi")
    power = F.floor(F.log2(F.abs(v))) + POWERS // 2
    by_power = F.when(v > 0, power).when(v < 0, -power).otherwise(0)
    steep = (F.signum(lo) * F.signum(hi) <= 0) | (F.greatest(F.abs(lo), F.abs(hi)) > 4 * F.least(F.abs(lo), F.abs(hi)))
    equal = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * (BINS - 1))).otherwise(0)
    bin_ = F.when(F.isnan(v), POWERS + 1).when(v == float("inf"), POWERS).when(v == float("-inf"), -POWERS).when(steep, by_power).otherwise(equal)
    rows = values.join(_few(ranges.select(*key, "_lo", "_hi")), key)
    return rows.groupBy(*key, bin_.cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("_held"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))


def _pick(bins: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The bin of each wanted rank, and the rank inside it."""
    before = F.coalesce(F.sum("_held").over(W.partitionBy(*key).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = bins.withColumn("_before", before).join(wanted, key)
    rows = rows.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_held")))
    return rows.select("_group", "_which", (F.col("_rank") - F.col("_before")).alias("_rank"), "_held", "_least", "_most")


def _within(values: DataFrame, picked: DataFrame, key: list[str]) -> DataFrame:
    """The values of the picked bins, for each rank by itself."""
    ranges = _few(picked.select("_group", "_which", "_least", "_most"))
    return values.join(ranges, key).where("_value between _least and _most").select("_group", "_which", "_value")

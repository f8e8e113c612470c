"""Interval joins by time bins.

Spark has no range join. The side with the intervals is laid out over the bins
of its width, the other side falls into one bin, and both meet by an equi-join
on keys and bin; the exact bounds are a filter after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(spans: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, at: Column, seconds: int, how: str = "inner", few: bool = False) -> DataFrame:
    """Rows of ``spans`` (with start and end in it) and of ``points`` (with a time) where start <= time <= end.

    ``seconds`` is the bins' width: about the usual length of an interval.
    ``few`` says that the spans were counted and are few enough to broadcast, so
    that points need no shuffle. Points carry the keys as ``_p_<key>``, which the result drops.
    """
    width = seconds * 1_000_000
    bin_of = lambda c: F.floor(F.unix_micros(c) / width)
    left = spans.withColumn("_start", start).withColumn("_end", end)
    left = left.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_start")), bin_of(F.col("_end")))))
    right = points.withColumn("_at", at).withColumn("_p_bin", bin_of(F.col("_at")))
    for k in keys:
        right = right.withColumnRenamed(k, f"_p_{k}")
    same = [left[k] == right[f"_p_{k}"] for k in keys] + [left["_bin"] == right["_p_bin"]]
    within = (F.col("_at") >= F.col("_start")) & (F.col("_at") <= F.col("_end"))
    on = within
    for c in same:
        on = c & on
    return (F.broadcast(left) if few else left).join(right, on, how).drop("_start", "_end", "_bin", "_at", "_p_bin", *(f"_p_{k}" for k in keys))

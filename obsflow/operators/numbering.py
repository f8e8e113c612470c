"""Numbers of rows within a key, without a task for a whole key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered(df: DataFrame, keys: list[str], time: str, tie: str, name: str, seconds: int = 3600) -> DataFrame:
    """Adds ``name``: the place of each row within its key by time and tie, from 1.

    Rows are numbered inside time bins, and each bin begins after the sum of
    those before it, so a key with a third of all rows is many small groups.
    """
    return numbered_in(df.withColumn("_bin", F.floor(F.unix_micros(time) / (seconds * 1_000_000))), keys, [time, tie], name)


def numbered_in(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``, as :func:`numbered`, to rows with their ``_bin``, whose order is that of the bins; drops _bin."""
    totals = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*(F.col(k).alias(f"_b_{k}") for k in [*keys, "_bin"]), before.alias("_before"))
    rows = rows.withColumn("_inside", F.row_number().over(W.partitionBy(*keys, "_bin").orderBy(*order)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in [*keys, "_bin"]])
    return rows.join(totals, on).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bin", "_inside", "_before", *(f"_b_{k}" for k in [*keys, "_bin"]))

"""Greedy spacing of events of a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.staging import stage


#: Rows of an island that are folded in one row; longer islands are walked in pieces.
FOLDED = 10_000
#: Spacings in a piece of a long island.
PIECE = 256


def spaced(df: DataFrame, keys: list[str], time: str, tie: str, seconds: int) -> DataFrame:
    """Rows that a greedy walk keeps: the first of a key, then each at least ``seconds`` after the last kept.

    A gap of ``seconds`` or more restarts the walk whatever came before, so keys
    are cut into islands at such gaps. A short island is folded by itself. A
    steady source can be one endless island, which :func:`_walked` cuts.
    """
    width = seconds * 1_000_000
    rows = stage(_islands(df, keys, time, tie, width), "fold-rows")
    sizes = rows.groupBy(*keys, "_island").agg(F.count(F.lit(1)).alias("_size"))
    long_ = sizes.where(F.col("_size") > FOLDED).select(*keys, "_island")
    none = F.expr("cast(array() as array<int>)")
    zero = F.struct(F.lit(None).cast("long").alias("last"), none.alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        take = acc["last"].isNull() | (p["_us"] - acc["last"] >= width)
        return F.struct(F.when(take, p["_us"]).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["kept"], F.array(p["_nth"]))).otherwise(acc["kept"]).alias("kept"))

    if long_.limit(1).count():
        short = rows.join(long_, [*keys, "_island"], "left_anti")
        more = _walked(rows.join(long_, [*keys, "_island"], "left_semi"), [*keys, "_island"], width)
    else:
        short, more = rows, None
    islands = short.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(F.struct("_us", "_nth"))).alias("points"))
    kept = islands.select(*keys, "_island", F.explode(F.aggregate("points", zero, step, lambda acc: acc["kept"])).alias("_nth"))
    kept = kept if more is None else kept.unionByName(more)
    return rows.join(kept, [*keys, "_island", "_nth"], "left_semi").drop("_island", "_nth", "_us")


def _islands(df: DataFrame, keys: list[str], time: str, tie: str, width: int) -> DataFrame:
    """Rows with _us, _nth in their key (from 1) and _island, the gaps of a key up to the row.

    Gaps and rows are counted inside slices of time. Slices are joined by their
    first and last times, in a scan over slices, not rows.
    """
    piece = PIECE * width
    rows = df.withColumn("_us", F.unix_micros(time)).withColumn("_slice", F.floor(F.col("_us") / piece))
    inside = W.partitionBy(*keys, "_slice").orderBy(time, tie)
    rows = rows.withColumn("_gap", F.coalesce(F.col("_us") - F.lag("_us").over(inside) >= width, F.lit(False)).cast("int"))
    rows = rows.withColumn("_gaps", F.sum("_gap").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(inside))
    slices = rows.groupBy(*keys, "_slice").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.sum("_gap").alias("_breaks"), F.count(F.lit(1)).alias("_held"))
    order = W.partitionBy(*keys).orderBy("_slice")
    door = F.coalesce(F.col("_first") - F.lag("_last").over(order) >= width, F.lit(True)).cast("int")
    slices = slices.withColumn("_door", door)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    slices = slices.select(*keys, "_slice", (F.col("_door") + before(F.col("_door") + F.col("_breaks"))).alias("_begun"), before(F.col("_held")).alias("_before"))
    rows = rows.join(slices, [*keys, "_slice"]).withColumn("_island", F.col("_begun") + F.col("_gaps")).withColumn("_nth", (F.col("_before") + F.col("_row")).cast("int"))
    return rows.drop("_slice", "_gap", "_gaps", "_row", "_begun", "_before")


def _exits(width: int, piece: int, found: str):
    """For a piece of an island: where a walk that enters at each of its rows leaves it.

    ``found`` is "exits" (one row for each possible entry: entry and exit time,
    null at the end) or "kept" (the rows that the walk from ``_entry`` keeps).
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_us", "_nth"]).drop_duplicates("_us")
        us, nth = group["_us"].to_numpy(), group["_nth"].to_numpy()
        own = us // piece == group["_piece"].iloc[0]
        onward = np.searchsorted(us, us + width)
        end = int(own.sum())
        if found == "kept":
            i, kept = int(np.searchsorted(us, group["_entry"].iloc[0])), []
            while i < end:
                kept.append(i)
                i = int(onward[i])
            return group.iloc[kept][[c for c in group.columns if c not in ("_us", "_piece", "_entry")]]
        out = np.full(end, -1, dtype=np.int64)
        for i in range(end - 1, -1, -1):
            j = int(onward[i])
            out[i] = out[j] if j < end else us[j] if j < len(us) else -1
        # A walk enters a piece less than two spacings after its begin, or at an island's first row.
        doors = np.flatnonzero((us[:end] < us[0] // piece * piece + 2 * width) | (nth[:end] == group["_first"].iloc[0]))
        names = [c for c in group.columns if c not in ("_us", "_nth", "_piece", "_first")]
        made = pd.DataFrame({"_entry": us[doors], "_exit": out[doors]})
        for c in names:
            made[c] = group[c].iloc[0]
        return made[[*names, "_entry", "_exit"]]

    return run


def _walked(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, _nth) that the walk keeps in long islands.

    Islands are cut into pieces of time, and each piece tells for every row by
    which a walk can enter where it leaves. Pointers over those entries are
    doubled until all entries that the walk reaches are known, and each reached
    piece is walked from its entry. No task holds more than a piece.
    """
    piece = PIECE * width
    points = rows.select(*keys, "_us", "_nth").withColumn("_home", F.floor(F.col("_us") / piece))
    # The rows of the next piece that an own row can lead to: an island has no gap of a spacing.
    lead = F.col("_us") - F.col("_home") * piece < 3 * width
    pieces = points.withColumn("_piece", F.explode(F.when(lead, F.array(F.col("_home"), F.col("_home") - 1)).otherwise(F.array("_home")))).drop("_home")
    first = points.groupBy(*keys).agg(F.min(F.struct("_us", "_nth")).alias("_f")).select(*keys, F.col("_f._us").alias("_start"), F.col("_f._nth").alias("_first"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    exits = pieces.join(first.drop("_start"), keys).groupBy(*keys, "_piece").applyInPandas(_exits(width, piece, "exits"), f"{kinds}, _entry long, _exit long")
    exits = stage(exits.distinct(), "fold-exits")
    known, jump = first.select(*keys, F.col("_start").alias("_entry")), exits
    size = -1
    while True:
        onward = known.join(jump, [*keys, "_entry"]).where("_exit >= 0").select(*keys, F.col("_exit").alias("_entry"))
        known = stage(known.union(onward).distinct(), "fold-known")
        grown = known.count()
        if grown == size:
            break
        size = grown
        ahead = jump.select(*keys, F.col("_entry").alias("_exit"), F.col("_exit").alias("_next"))
        jump = stage(jump.join(ahead, [*keys, "_exit"]).select(*keys, "_entry", F.col("_next").alias("_exit")), "fold-jump")
    entered = known.withColumn("_piece", F.floor(F.col("_entry") / piece)).groupBy(*keys, "_piece").agg(F.min("_entry").alias("_entry"))
    return pieces.join(entered, [*keys, "_piece"]).groupBy(*keys, "_piece").applyInPandas(_exits(width, piece, "kept"), f"{kinds}, _nth int").select(*keys, "_nth")


def throttle(df: DataFrame, keys: list[str], time: str = "event_time", tie: str = "event_id", gap: int = 60) -> DataFrame:
    """Reports spaced by at least ``gap`` seconds for each key."""
    return spaced(df, keys, time, tie, gap)

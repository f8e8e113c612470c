"""Deduplication against a long history, of which only the parts with possible hits are read.

Stored keys lie by day of the event and bucket of the key's hash. Each batch
leaves a Bloom filter for each of its days and buckets: blocks of eight words
(a key has one block, and two bits in each word), a row for each block. A new batch
meets the filters by an equi-join on bucket and block, and then reads the
days and buckets alone in which some key may be. What is read decides, so the
filters never change the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.operators.tables import first_by
from obsflow.streaming.store import BatchStore

KEYS = ["tenant_id", "event_id"]
WORDS = 8
_WORDS = [f"w{i}" for i in range(WORDS)]


class Ledger:
    """Keys of all events let through so far.

    ``buckets`` and ``blocks`` are fixed for a ledger. A block is meant for some 16 keys,
    so ``buckets * blocks * 16`` is the number of events of a day (and batch) at which
    the filters are still sharp; beyond it more is read.
    """

    def __init__(self, path: str, buckets: int = 64, blocks: int = 4096):
        self.buckets, self.blocks = buckets, blocks
        self.keys = BatchStore(f"{path}/keys", "tenant_id string, event_id string, day date, bucket int", ("day", "bucket"))
        self.filters = BatchStore(f"{path}/filters", "day date, bucket int, block int, " + ", ".join(f"{w} long" for w in _WORDS))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with bucket, block and the bits of each word."""
        a, b = F.xxhash64(*KEYS, F.lit("a")), F.xxhash64(*KEYS, F.lit("b"))
        bit = lambda h, i: f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * i}) & 63 as int))"
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")).withColumn("block", F.pmod(F.xxhash64(*KEYS, F.lit("block")), F.lit(self.blocks)).cast("int"))
        rows = rows.withColumn("_a", a).withColumn("_b", b)
        return rows.withColumns({w: F.expr(f"{bit('_a', i)} | {bit('_b', i)}") for i, w in enumerate(_WORDS)}).drop("_a", "_b")

    def _parts(self, batch: DataFrame, batch_id: int) -> dict:
        """Buckets by day in which keys of the batch may be; at most days times buckets."""
        asked = self._placed(batch.select(*KEYS).where("tenant_id is not null and event_id is not null").distinct()).drop(*KEYS)
        held = self.filters.read(batch.sparkSession, batch_id).select("day", "bucket", "block", *(F.col(w).alias(f"f_{w}") for w in _WORDS))
        hit: Column = reduce(lambda x, y: x & y, (F.col(f"f_{w}").bitwiseAND(F.col(w)) == F.col(w) for w in _WORDS))
        found: dict = {}
        for day, bucket in asked.join(held, ["bucket", "block"]).where(hit).select("day", "bucket").distinct().collect():
            found.setdefault(day, []).append(bucket)
        return found

    def possible(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Stored keys of the days and buckets where keys of the batch may be."""
        rows = self.keys.read(batch.sparkSession, batch_id)
        at = [F.col("day").eqNullSafe(F.lit(day)) & F.col("bucket").isin(sorted(buckets)) for day, buckets in self._parts(batch, batch_id).items()]
        return rows.where(reduce(lambda x, y: x | y, at)) if at else rows.where("false")

    def fresh(self, batch: DataFrame, batch_id: int, order: tuple[str, ...] = ("event_time",)) -> DataFrame:
        """The first of each (tenant, event) of the batch that no earlier batch let through.

        Events without a tenant or an id are never taken for stored ones.
        """
        return first_by(batch.join(self.possible(batch, batch_id).select(*KEYS), KEYS, "left_anti"), KEYS, list(order))

    def record(self, fresh: DataFrame, batch_id: int) -> None:
        """Store the keys of what a batch let through. A batch that runs again replaces its own."""
        placed = self._placed(fresh.select(*KEYS, F.to_date("event_time").alias("day")).where("tenant_id is not null and event_id is not null"))
        # Filters first: keys without their filter would be missed, filters without keys only cost a look.
        self.filters.write(placed.groupBy("day", "bucket", "block").agg(*(F.bit_or(w).alias(w) for w in _WORDS)), batch_id)
        self.keys.write(placed.select(*KEYS, "day", "bucket").repartition("day", "bucket"), batch_id)

    def compact(self, spark: SparkSession, upto: int, since=None) -> None:
        """Merge the batches up to a finished one, and forget events of days before ``since``."""
        young = lambda df: df if since is None else df.where(F.col("day").isNull() | (F.col("day") >= F.lit(since).cast("date")))
        self.keys.compact(spark, upto, lambda df: young(df).repartition("day", "bucket"))
        self.filters.compact(spark, upto, lambda df: young(df).groupBy("day", "bucket", "block").agg(*(F.bit_or(w).alias(w) for w in _WORDS)))


def append_sink(ledger: Ledger, out):
    """A sink for :func:`obsflow.streaming.pipeline.run_pipeline`: writes each event once, over repeated batches too."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = ledger.fresh(batch, batch_id).persist()
        try:
            out(fresh, batch_id)
            ledger.record(fresh, batch_id)
        finally:
            fresh.unpersist()

    return write

"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsflow.staging import discard, shared_dir, stage

__all__ = ["BATCH", "bounded_broadcast", "discard", "let", "map_batches", "running", "shared_dir", "stage", "table"]


#: Rows of an Arrow batch that goes to Python.
BATCH = 512
#: Entries of a block of a running sum.
BLOCK = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH`` rows at most.

    Rows are whole texts, so that many fit beside an executor's heap. A session
    that asks for smaller batches keeps them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH:
        df.sparkSession.conf.set(name, str(BATCH))
    return df.mapInArrow(run, schema)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` stay within ``limit``; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The running sums (or other combinations, from 0) of an array of numbers, with SQL functions only.

    A fold that appends to its result copies it at every step. So sums are taken
    by blocks, folded over the blocks, and only then inside each block.
    """

    def make(x: Column) -> Column:
        n = F.size(x)
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
        part = lambda b: F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1)
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, i: combine(a, x[i])))
        append = lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v)))
        before = F.aggregate(sums, F.array(F.lit(0)), append)
        inside = lambda first: F.transform(blocks, lambda b: F.aggregate(part(b), F.array(first[b]), lambda acc, i: append(acc, x[i]), lambda acc: F.slice(acc, F.lit(2), F.size(acc) - 1)))
        return F.when(n > 0, F.flatten(let(before, inside))).otherwise(F.expr("cast(array() as array<int>)"))

    return let(values, make)

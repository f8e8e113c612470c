"""Tables that grow by micro-batches: each batch is its own folder, and a repeated batch replaces it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Step = Callable[[DataFrame], DataFrame]


class BatchStore:
    """Folders ``part=batch-<id>`` and ``part=base-<id>`` under one path that the whole cluster shares.

    A base holds all batches up to its id. Only folders with Spark's mark of a
    finished job count, so a batch or base that was cut short is as if it had never
    been begun. One query writes to a store.
    """

    def __init__(self, path: str, schema: StructType | str, partition_by: tuple[str, ...] = ()):
        self.path, self.schema, self.partition_by = path.rstrip("/"), schema, list(partition_by)

    def _files(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _held(self, spark: SparkSession) -> dict[str, list[int]]:
        """Ids of finished folders by kind."""
        root, fs = self._files(spark)
        found: dict[str, list[int]] = {"base": [], "batch": []}
        for status in fs.listStatus(root) if fs.exists(root) else []:
            told = re.fullmatch(r"part=(base|batch)-(\d+)", status.getPath().getName())
            if told and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[told[1]].append(int(told[2]))
        return found

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.path}/part=batch-{batch_id}")

    def read(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        """Rows of all batches, or of those with a smaller id than ``below``: a batch that runs again doesn't see itself."""
        held = self._held(spark)
        upto = max(held["base"], default=-1)
        if below is not None and below <= upto:
            raise ValueError(f"batch {below} is in the base up to {upto} already")
        ids = [i for i in sorted(held["batch"]) if i > upto and (below is None or i < below)]
        folders = [f"{self.path}/part=base-{upto}"] * (upto >= 0) + [f"{self.path}/part=batch-{i}" for i in ids]
        return spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders).drop("part") if folders else spark.createDataFrame([], self.schema)

    def compact(self, spark: SparkSession, upto: int, merge: Step = lambda df: df) -> None:
        """Merge the batches up to a finished one into a new base; what it replaces is removed after that."""
        held = self._held(spark)
        if upto <= max(held["base"], default=-1):
            return
        merge(self.read(spark, upto + 1)).write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.path}/part=base-{upto}")
        _, fs = self._files(spark)
        old = [f"part=base-{i}" for i in held["base"]] + [f"part=batch-{i}" for i in held["batch"] if i <= upto]
        for name in old:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


class BatchState:
    """State of all batches: each adds its own partial states, which are merged when they are read.

    ``make`` turns a batch's rows into partial states and ``merge`` makes one state
    of several, in any order and grouping. No batch reads or rewrites what came before.
    """

    def __init__(self, path: str, schema: StructType | str, make: Step, merge: Step):
        self.store, self.make, self.merge = BatchStore(path, schema), make, merge

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch; also a sink of :func:`obsflow.streaming.pipeline.run_pipeline`."""
        self.store.write(self.make(batch), batch_id)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.merge(self.store.read(spark))

    def compact(self, spark: SparkSession, upto: int) -> None:
        self.store.compact(spark, upto, self.merge)

"""Tables written once into the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset (tests do); it then gets a folder
    of its own. On a cluster an unset folder is an error, because a
    machine-local one would lose tables with the machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    own = os.path.join(tempfile.gettempdir(), f"obsflow-{os.getuid()}-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage at files that every executor can reach, so that a
    lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/obsflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing later reads, so that rounds of a loop don't pile up."""
    found = df.inputFiles()
    if found:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

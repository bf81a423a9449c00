"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that would not be shared, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="boutline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of scratch space, if it is there."""
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended first
        pass


def scratch_folder(spark: SparkSession, name: str = "files") -> str:
    """A new place in the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it again, so that what is built on it does not run it anew; survives lost executors.

    What was shuffled for it is not needed any more: Spark's cleaner drops those files after a collection of the driver's memory.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)

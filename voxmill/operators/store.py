"""The folder that driver and executors share, and tables that are written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on a single machine without it, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return configured or tempfile.mkdtemp(prefix="voxmill-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read from it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Rounds:
    """The table of a loop, written anew in every round; what a round before wrote is removed when the next one is written.

    Files say how large they are. A checkpoint keeps the optimizer's estimate instead, which for a table that is
    joined to itself is squared in every round until the planner can no longer multiply it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.before = spark, f"{shared_folder(spark)}/voxmill-{uuid.uuid4().hex}", None
        self.number = 0

    def next(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        if self.before:
            remove(self.spark, self.before)
        self.before, self.number = path, self.number + 1
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        """Remove what the last round wrote."""
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


class Scratch:
    """Tables written under the shared folder, so that lineage ends there and a lost executor costs one stage.

    Spark deletes what is left of them when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write df and return a DataFrame that reads it."""
        write = df.write.mode("overwrite").option("compression", "zstd")
        (write.partitionBy(*partition_by) if partition_by else write).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that are gone now rather than when the driver's garbage is next
        collected. For once or twice in a job that has just shuffled as much as it read; not for every round of a loop."""
        self.spark.sparkContext._jvm.System.gc()

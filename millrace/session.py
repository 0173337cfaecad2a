"""A session with the settings that this library is laid out for, and the tables of a folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "millrace", **settings: str) -> SparkSession:
    """An adaptive session in UTC; settings override, e.g. session(**{"spark.master": "local[8]"})."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (conf | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What runs inside gives Python batches of so many bytes, or of one row that is larger; by itself Spark bounds only their rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, dealt out to all cores where the files are small and fewer than those.

    A file of one row group can't be split, so a small table in few files would be worked on by few cores. Files that
    are larger than a task's share of input, or many, stay as they are: the shuffle is never larger than a task's share
    for each core.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, len(df.inputFiles())
    share = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 0 < files < cores and size <= files * share else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

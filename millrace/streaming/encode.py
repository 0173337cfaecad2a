"""Encoding a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bpe


def encode_stream(texts: DataFrame, codec: bpe.Codec) -> DataFrame:
    """texts (doc_id, text) with ids. Each row is encoded for itself, so there is no state."""
    return texts.select("doc_id", bpe.encoder(codec)(F.col("text")).alias("ids"))


def encode_folder(spark: SparkSession, folder: str, codec: bpe.Codec, out: str, checkpoint: str) -> DataFrame:
    """Encode all files of a folder of Parquet tables (doc_id, text) as a stream and return what was written."""
    source = spark.readStream.schema("doc_id long, text string").parquet(folder)
    query = encode_stream(source, codec).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("doc_id long, ids array<int>").parquet(out)


def log_metrics(metrics: DataFrame, out: str, checkpoint: str):
    """Append a stream of metrics (step, name, value) to a table, batch by batch; a batch that comes again is
    written to the same place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

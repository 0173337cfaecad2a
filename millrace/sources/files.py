"""Documents as files: reading paths, writing one file for each document, dedup from files to files."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.scratch import Scratch
from millrace.sources.text import utf8_or_signs


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id (in order of the paths given), name, text. The name is the file's; where several have the same, the number
    goes before it, so that names differ."""
    base = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    several = {n for n, k in Counter(base).items() if k > 1}
    names = [f"{i}-{n}" if n in several else n for i, n in enumerate(base)]
    order = spark.createDataFrame([(i, _full(spark, p), n) for i, (p, n) in enumerate(zip(paths, names, strict=True))], "doc_id long, path string, name string")
    rows = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).select("path", utf8_or_signs("content").alias("text"))
    return order.join(rows, "path").select("doc_id", "name", "text")


def _full(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers give it: with its scheme, and from the root on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toString()


def write_files(docs: DataFrame, folder: str) -> int:
    """One file for each row of docs (name, text), in UTF-8; names must differ. Returns how many.

    A file is written under another name first, so that a task that runs twice leaves whole files.
    """
    uri = folder if "://" in folder else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root)
        n = 0
        for b in batches:
            for name, text in zip(b.column(0), b.column(1), strict=True):
                temp = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as out:
                    out.write((text.as_py() or "").encode("utf-8"))
                store.move(temp, f"{root}/{name.as_py()}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return docs.select("name", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def exact_line_files(spark: SparkSession, paths: list[str], folder: str) -> int:
    """Write each file without the lines that occur more than once in all of them."""
    docs = read_files(spark, paths)
    return write_files(dedup.exact_lines(docs), folder)


def minhash_files(spark: SparkSession, paths: list[str], folder: str, num_hashes: int, num_bands: int, ngrams: int, jaccard_threshold: float) -> int:
    """Write one file of each group of near-duplicates, as it is."""
    docs = Scratch(spark, "files").table(read_files(spark, paths), "docs")
    params = dedup.MinHash(num_hashes, num_bands, ngrams, jaccard_threshold)
    kept = dedup.minhash_clusters(docs, params).where("doc_id = cluster").select("doc_id")
    return write_files(docs.join(kept, "doc_id", "left_semi"), folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    """Results as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(folder)

"""Corpora of text files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.ordering import free_names, sums_before
from millrace.scratch import Scratch


@F.pandas_udf(StringType())
def utf8_or_signs(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as UTF-8, U+FFFD for what is broken."""
    for d in data:
        yield d.map(lambda x: None if x is None else bytes(x).decode("utf-8", errors="replace"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row for each file that holds anything; signs for what is no UTF-8."""
    return spark.read.format("binaryFile").load(path).select("path", utf8_or_signs("content").alias("text"))


def delimited(spark: SparkSession, path: str, delimiter: str = "<|endoftext|>") -> DataFrame:
    """text: the parts of text files between delimiters. Files are split for reading, whatever the delimiter."""
    return spark.read.option("lineSep", delimiter).text(path).select(F.col("value").alias("text"))


def first_characters(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, text: texts in order of id as long as they begin within the first `most` characters, the last one cut.

    Lengths are added up range by range, so no task sums over all rows. Rows without an id come first, rows of one id in
    order of their texts; null texts have no characters.
    """
    scratch = Scratch(docs.sparkSession, "first")
    (before,) = free_names(1, docs)
    rows = docs.select("doc_id", "text")
    placed = sums_before(scratch, rows, [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()], {before: F.coalesce(F.length("text"), F.lit(0)).cast("long")}, "texts")
    return placed.where(F.col(before) < most).select("doc_id", F.substring("text", F.lit(1), F.least(F.lit(most) - F.col(before), F.lit((1 << 31) - 1)).cast("int")).alias("text"))


def chunk_boundaries(text: Column, chunks: int, delimiter: str) -> Column:
    """Places at which a text may be cut into about so many chunks: even guesses, moved on to the next delimiter.

    Sorted and distinct, from 0 to the length; a guess with no delimiter after it moves to the end.
    """
    size = F.length(text)
    step = F.greatest(F.floor(size / chunks), F.lit(1)).cast("int")

    def moved(k: Column) -> Column:
        found = F.instr(F.substr(text, k * step + 1), F.lit(delimiter))
        return F.when(found > 0, k * step + found - 1).otherwise(size)

    inner = F.transform(F.sequence(F.lit(1), F.lit(chunks - 1)), moved) if chunks > 1 else F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(size))))


def preview(text: Column, n: int = 500) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)

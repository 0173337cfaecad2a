"""Sharding along a Hilbert curve: rows with like metadata lie together, runs of the curve become shards.

Every dimension is quantised to 2**BITS levels of about equal weight, the levels are mixed to one curve index, rows
are sorted by it (ties by id, so that a value which a third of all rows hold splits like any other) and the order is
cut into runs whose row counts differ by one at most. Each run then spans short ranges in all dimensions at once:
manifest() lists them and prune() names the shards a filter can't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.ordering import free_names, sums_before

from .common import Scratch, attach, columns_of, global_rank

BITS = 8
SHARDS = 8


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points given as an array (dimensions, points) of integers below 2**bits.

    The inverse of Skilling's construction ("Programming the Hilbert curve", 2004), over whole columns.
    """
    x = axes.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _quantised(rows: DataFrame, name: str, level: str, bits: int, total: int, scratch: Scratch) -> DataFrame:
    """rows with column `level`: the level of column `name`; null is level 0."""
    levels = 1 << bits
    if isinstance(rows.schema[name].dataType, StringType):
        # a value's level is where its middle lies among all rows sorted by value
        values = scratch.table(rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")), f"values_{level}")
        placed = sums_before(scratch, values, [F.col("value").asc_nulls_first()], {"before": F.col("n")}, f"placed_{level}")
        at = F.least(F.floor((F.col("before") + F.col("n") / 2) * levels / max(1, total)), F.lit(levels - 1)).cast("int")
        placed = placed.select(F.col("value").alias(name), F.when(F.col("value").isNull(), 0).otherwise(at).alias(level))
        return attach(rows, scratch.table(placed, f"levels_{level}"), name, F.struct(*columns_of(rows)))
    cuts = rows.agg(F.percentile_approx(F.col(name).cast("double"), [i / levels for i in range(1, levels)], 10 * levels)).first()[0]
    cuts = sorted(set(cuts or []))  # below 2**bits numbers
    if not cuts:
        return rows.withColumn(level, F.lit(0))
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    at = F.size(F.filter(bounds, lambda b: b <= F.col(name).cast("double")))
    return rows.withColumn(level, F.when(F.col(name).isNull(), 0).otherwise(at).cast("int"))


def hilbert_shards(rows: DataFrame, dims: list[str], n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """rows (doc_id and at least the columns dims) with columns curve, shard, slot: row counts one apart at most.

    The order is by curve, then by id, so rows of equal texts lie together only as far as their metadata do: with row
    counts one apart at most, a group of copies that holds a third of all rows can't stay in one shard. Null ids and
    null dimensions count as lowest. Equal rows keep an arbitrary order among themselves; whatever order that is, the
    result is the same set of rows. Columns curve, shard and slot of rows are replaced, others may have any names. An
    empty table gives an empty result.
    """
    if bits * len(dims) > 62:
        raise ValueError("the curve index must fit 62 bits")
    if {"curve", "shard", "slot"} & set(dims):
        raise ValueError("curve, shard and slot can't be dimensions")
    scratch = Scratch(rows.sparkSession, "shard")
    rows = scratch.table(rows.drop("curve", "shard", "slot"), "rows")
    total = rows.count()
    *levels, rank = free_names(len(dims) + 1, rows)
    placed = rows
    for d, level in zip(dims, levels, strict=True):
        placed = _quantised(placed, d, level, bits, total, scratch)

    @F.pandas_udf("long")
    def index(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in it:
            yield pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns]), bits))

    placed = placed.withColumn("curve", index(*levels))
    placed = scratch.table(placed.select(*columns_of(rows), "curve"), "placed")
    ties = [c.asc_nulls_first() for c, (name, kind) in zip(columns_of(rows), rows.dtypes, strict=True) if name != "doc_id" and not kind.startswith(("map", "variant"))]
    ranked = global_rank(scratch, placed, [F.col("curve").asc(), F.col("doc_id").asc_nulls_first(), *ties], "ranked", into=rank)
    if not total:
        return ranked.withColumn("shard", F.lit(0)).withColumnRenamed(rank, "slot")
    shard = F.expr(f"{rank} * {n_shards} div {total}").cast("int")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col(rank) - first).drop(rank)


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """One row per shard: rows, and the least and greatest value of each dimension (nulls aside, with their count)."""
    stats: list[Column] = [F.count("*").alias("rows")]
    for d in dims:
        stats += [F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}"), F.count_if(F.col(d).isNull()).alias(f"nulls_{d}")]
    return sharded.groupBy("shard").agg(*stats)


def prune(shards: DataFrame, ranges: dict[str, tuple]) -> list[int]:
    """Shards of a manifest that can hold rows with low <= value <= high in all the given dimensions."""
    for d, (low, high) in ranges.items():
        shards = shards.where((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return sorted(r["shard"] for r in shards.select("shard").collect())


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size (UTF-8 bytes of the text plus 1) and text_crc32 of documents; a null text is empty."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select("doc_id", "source", "lang", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))

"""What the operators of this subpackage share: scratch tables, ranks, lookups that bear hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.ordering import free_names
from millrace.scratch import Scratch

#: Most rows of a table that is broadcast as a lookup; larger ones are shuffled.
MAX_BROADCAST_ROWS = 100_000
#: A key of a lookup counts as hot beyond this many rows (or beyond 1/4096 of all, if that is more).
HOT_ROWS = 200
MAX_HOT_KEYS = 4096


def values(column: pa.Array | pa.ChunkedArray) -> Iterator:
    """A column's values one by one, so that a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)


def id_crc(column: str | Column) -> Column:
    """CRC-32 of an id written as decimal text, unsigned; an id that is null counts as empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8"))


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def global_rank(scratch: Scratch, df: DataFrame, order: list[Column], name: str, into: str = "rank") -> DataFrame:
    """df with each row's position (from 0) in a total order; one range shuffle, no task with all rows.

    The sorted rows are written once; a row's place in its partition is known as it is written, and the
    partitions' offsets are sums over one row per partition.
    """
    # range partitioning looks at its input twice, so df should be a table, not an expensive plan
    at, part, start = [x for x in free_names(4, df) if x != into][:3]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = scratch.table(ordered.withColumn(at, F.monotonically_increasing_id()), name)
    of = F.shiftright(F.col(at), 33)
    counts = {r["part"]: r["n"] for r in ordered.groupBy(of.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(counts):  # one entry per partition of the shuffle
        starts.append((int(p), before))
        before += counts[p]
    offsets = scratch.spark.createDataFrame(starts or [(0, 0)], f"{part} long, {start} long")
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn(part, of).join(F.broadcast(offsets), part).withColumn(into, F.col(start) + inside).drop(part, start, at)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], rows: str, how: str = "left") -> DataFrame:
    """Join big (many rows a key) with small (one row a key, whose column `rows` counts the key's rows in big).

    Keys with more than max(HOT_ROWS, all/MAX_HOT_KEYS) rows in big are at most MAX_HOT_KEYS, since their rows add
    up to no more than all; those are broadcast, the rest is shuffled. Null keys match null keys. `rows` is dropped.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    limit = max(HOT_ROWS, total // MAX_HOT_KEYS)
    others = [c for c in small.columns if c not in (*keys, rows)]
    names = dict(zip(keys, free_names(len(keys), big, small), strict=True))

    def renamed(side: DataFrame) -> DataFrame:
        return side.select(*[F.col(k).alias(names[k]) for k in keys], *others)

    def on(side: DataFrame) -> Column:
        condition = F.lit(True)
        for k in keys:
            condition = condition & big[k].eqNullSafe(side[names[k]])
        return condition

    drop = list(names.values())
    hot, cold = renamed(small.where(F.col(rows) > limit)), renamed(small.where(F.col(rows) <= limit))
    if not small.where(F.col(rows) > limit).limit(1).count():
        return big.join(cold, on(cold), how).drop(*drop)
    a = big.join(F.broadcast(hot), on(hot), "inner").drop(*drop)
    rest = big.join(F.broadcast(hot), on(hot), "left_anti")
    b = rest.join(cold, on(cold), how).drop(*drop)
    return a.unionByName(b)


def attach(big: DataFrame, small: DataFrame, key: str, salt: Column, buckets: int = 64) -> DataFrame:
    """Join big with small on key (null matches null), where one key may hold any share of big.

    small is broadcast if it is counted at MAX_BROADCAST_ROWS rows or fewer; beyond that its rows are repeated for
    each of `buckets` salts and big is dealt out by key and salt.
    """
    name, one, two = free_names(3, big, small)
    side = small.withColumnRenamed(key, name)
    if side.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return big.join(F.broadcast(side), big[key].eqNullSafe(side[name]), "left").drop(name)
    side = side.withColumn(two, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    big = big.withColumn(one, F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int"))
    return big.join(side, big[key].eqNullSafe(side[name]) & (big[one] == side[two]), "left").drop(name, one, two)

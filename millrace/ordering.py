"""Sums over all rows before each row of a total order, without a task that sees all rows."""

from __future__ import annotations

from itertools import count, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.scratch import Scratch


def free_names(n: int, *sides: DataFrame) -> list[str]:
    """n column names that none of the tables has, whatever the case of their letters."""
    taken = {c.lower() for side in sides for c in side.columns}
    return list(islice((name for name in (f"_m{k}" for k in count()) if name not in taken), n))


def sums_before(scratch: Scratch, df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for each of sums (column name, value), the sum of the values of all rows before it in the order; one range
    shuffle. The sorted rows are written once; one row for each partition meets in the driver."""
    at, part, *names = [x for x in free_names(2 + 3 * len(sums), df) if x not in sums][: 2 + 2 * len(sums)]
    value, start = dict(zip(sums, names, strict=False)), dict(zip(sums, names[len(sums) :], strict=True))
    ordered = df.withColumns({value[k]: v for k, v in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = scratch.table(ordered.withColumn(at, F.monotonically_increasing_id()), name).withColumn(part, F.shiftright(F.col(at), 33))
    kind = {k: ordered.schema[value[k]].dataType.simpleString() for k in sums}
    totals = ordered.groupBy(part).agg(*[F.sum(value[k]).alias(start[k]) for k in sums]).orderBy(part).collect()
    now, rows = dict.fromkeys(sums, 0), []
    for r in totals:
        rows.append((r[part], *[float(x) if kind[k] == "double" else x for k, x in now.items()]))
        now = {k: now[k] + (r[start[k]] or 0) for k in sums}
    offsets = scratch.spark.createDataFrame(rows, f"{part} long, " + ", ".join(f"{start[k]} {kind[k]}" for k in sums))
    inside = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    before = {k: F.col(start[k]) + F.coalesce(F.sum(value[k]).over(inside), F.lit(0).cast(kind[k])) for k in sums}
    return ordered.join(F.broadcast(offsets), part).withColumns(before).drop(at, part, *names)


def places_in_groups(scratch: Scratch, df: DataFrame, group: str, order: list[Column], place: str, size: str, name: str) -> DataFrame:
    """df with each row's place (from 0) among the rows of its group, in an order, and the group's size. Places come from one order
    of all rows, so a group of any share of them is worked on by many tasks. A null group is one."""
    at, first, key = [x for x in free_names(5, df) if x not in (place, size)][:3]
    placed = sums_before(scratch, df, [F.col(group).asc_nulls_first(), *order], {at: F.lit(1).cast("long")}, name)
    placed = scratch.table(placed, f"{name}_places")
    groups = placed.groupBy(F.col(group).alias(key)).agg(F.min(at).alias(first), F.count("*").alias(size))
    joined = placed.join(groups, placed[group].eqNullSafe(groups[key]))
    return joined.withColumn(place, F.col(at) - F.col(first)).drop(at, first, key)

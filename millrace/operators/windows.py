"""Windows, order and sampling: next tokens, contexts, top-k, nucleus, shards, buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.ordering import free_names, sums_before
from millrace.scratch import Scratch


def next_tokens(tokens: Column) -> Column:
    """Structs (x, y) of each token and the one after it."""

    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    return let(tokens, pairs)


def context_windows(tokens: Column, length: int, stride: int) -> Column:
    """Structs (start, x, y): windows of `length` tokens at every stride, y being x moved by one. None if too short."""

    def cut(t: Column) -> Column:
        last = F.size(t) - length - 1
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(t, s + 1, length).alias("x"), F.slice(t, s + 2, length).alias("y")))

    return let(tokens, cut)


def random_windows(rows: DataFrame, length: int, each: int, seed: int) -> DataFrame:
    """rows (doc_id, tokens) to doc_id, start, x, y: `each` windows of `length` tokens a row at starts drawn by a hash of
    seed, id and number, y being x moved by one. Rows that are too short give none. Reruns agree."""
    room = F.size("tokens") - length  # starts from 0 to room - 1
    numbered = rows.where(room > 0).select("doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"))
    start = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k"), room).cast("int")
    placed = numbered.select("doc_id", start.alias("start"), "tokens")
    return placed.select("doc_id", "start", F.slice("tokens", F.col("start") + 1, length).alias("x"), F.slice("tokens", F.col("start") + 2, length).alias("y"))


def batches(windows: DataFrame, size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows (doc_id, start, x, y) as batches of arrays (size, length) in an order drawn by a hash; the last batch may be
    smaller. Partitions come to the driver one after another, so it holds one of them and a batch."""
    order = [F.xxhash64(F.lit(seed), "doc_id", "start"), F.col("doc_id"), F.col("start")]
    held: list = []
    for r in windows.repartitionByRange(*order).sortWithinPartitions(*order).select("x", "y").toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield np.array([h["x"] for h in held]), np.array([h["y"] for h in held])
            held = []
    if held:
        yield np.array([h["x"] for h in held]), np.array([h["y"] for h in held])


def last_tokens(tokens: Column, n: int) -> Column:
    """The last n tokens, or all."""
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def distribution(counts: DataFrame, temperature: float = 1.0) -> DataFrame:
    """item, p: softmax of log counts over a temperature, that is counts ** (1 / t) in shares (item, n)."""
    t = temperature if temperature > 0 else 1e-8
    powers = counts.select("item", F.exp(F.log(F.col("n").cast("double")) / F.lit(t)).alias("w"))
    total = powers.agg(F.sum("w").alias("total"))
    return powers.join(F.broadcast(total)).select("item", (F.col("w") / F.col("total")).alias("p"))


def top_k(probabilities: DataFrame, k: int) -> DataFrame:
    """item, p of the k likeliest and of those as likely as the k-th."""
    least = probabilities.orderBy(F.desc("p")).limit(k).agg(F.min("p").alias("least"))
    return probabilities.join(F.broadcast(least), F.col("p") >= F.col("least")).select("item", "p")


def top_p(probabilities: DataFrame, p: float) -> DataFrame:
    """item, p of the smallest set of likeliest items that passes p, made to sum to 1 (ties in order of item).

    An item stays if what lies before it is at most p. Items of equal probability are first added up by probability,
    of which there are few, so that the running sum isn't taken over all items in one task.
    """
    levels = probabilities.groupBy("p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col("p") * F.col("n")).over(W.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    levels = levels.withColumn("before", before).where(F.col("before") <= p)
    # of a level, as many as it takes
    levels = levels.withColumn("take", F.least("n", F.floor((p - F.col("before")) / F.col("p") + 1e-9) + 1))
    levels = levels.withColumn("kept", F.sum(F.col("p") * F.col("take")).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    whole = levels.where("take = n").select(F.col("p").alias("_p"), "kept")
    cut = levels.where("take < n").select(F.col("p").alias("_p"), "kept", "take")
    all_of = probabilities.join(F.broadcast(whole), F.col("p") == F.col("_p")).select("item", (F.col("p") / F.col("kept")).alias("p"))
    some = probabilities.join(F.broadcast(cut), F.col("p") == F.col("_p"))
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("p").orderBy("item"))).where("_r <= take")
    return all_of.unionByName(some.select("item", (F.col("p") / F.col("kept")).alias("p")))


def draw(probabilities: DataFrame, u: float) -> DataFrame:
    """The item whose share of [0, 1) holds u, items in order (one multinomial draw). The running sum is taken range by
    range; where u lies beyond the sum of all, since that isn't quite 1, there is no row."""
    (before,) = free_names(1, probabilities)
    placed = sums_before(Scratch(probabilities.sparkSession, "draw"), probabilities, [F.col("item").asc()], {before: F.col("p")}, "items")
    return placed.where((F.col(before) <= u) & (F.col(before) + F.col("p") > u)).orderBy(before).limit(1).select("item", "p")


def race(weight: Column, *of: Column) -> Column:
    """The time at which an item of this weight arrives, exponentially distributed with the weight as its rate, from a hash of
    the columns. Of several items the first to arrive is each with a chance in proportion to its weight. Null where the weight
    isn't above zero, so that such an item never comes."""
    digits = F.substring(F.md5(F.encode(F.concat_ws(":", *[c.cast("string") for c in of]), "UTF-8")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.when(weight > 0, -F.log(u) / weight)


def draws(weighted: DataFrame, times: int, seed: int) -> DataFrame:
    """group, draw, item: `times` independent draws from the distribution of each group of weighted (group, item, weight), which
    need not sum to 1. Each draw is a race: the least arrival, an aggregate that is taken before the shuffle, so a group
    of any size costs one row a task and draw. Ties go to the lesser item; reruns agree; groups without a positive weight have none.
    """
    numbers = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("draw")
    rows = weighted.where("weight > 0").select("group", "item", "weight", numbers)
    arrives = race(F.col("weight"), F.lit(seed), F.col("draw"), F.col("group"), F.col("item"))
    first = rows.groupBy("group", "draw").agg(F.min(F.struct(arrives.alias("at"), "item")).alias("first"))
    return first.select("group", "draw", "first.item")


def draw_without_return(weighted: DataFrame, most: int, seed: int) -> DataFrame:
    """group, place, item: of each group up to `most` different items, drawn one after another in proportion to the weights of
    those that are left: the first arrivals of one race."""
    arrives = race(F.col("weight"), F.lit(seed), F.lit(0), F.col("group"), F.col("item"))
    rows = weighted.where("weight > 0").select("group", "item", arrives.alias("at"))
    # the first of each of some parts of a group, before its rows meet
    part = F.pmod(F.xxhash64("item"), F.lit(64))
    some = rows.withColumn("place", F.row_number().over(W.partitionBy("group", part).orderBy("at", "item"))).where(F.col("place") <= most)
    placed = some.withColumn("place", F.row_number().over(W.partitionBy("group").orderBy("at", "item"))).where(F.col("place") <= most)
    return placed.select("group", "place", "item")


def round_robin(position: Column, n: int) -> Column:
    """Owner of the item at a position counted from 0."""
    return F.pmod(position, F.lit(n))


def contiguous(position: Column, total: Column, n: int) -> Column:
    """Shard of total / n items in a row; what is left over goes to the last."""
    return F.least(F.floor(position / F.greatest(F.floor(total / n), F.lit(1))), F.lit(n - 1)).cast("long")


def size_buckets(sizes: Column, limit: float) -> Column:
    """Bucket of each of an array of sizes, in order: a bucket is closed before a size that would take it beyond the
    limit, and once it has reached it."""

    def step(state: Column, size: Column) -> Column:
        opens = ((state["used"] > 0) & (state["used"] + size > limit)) | (state["used"] >= limit)
        bucket = F.when(opens, state["bucket"] + 1).otherwise(state["bucket"])
        used = F.when(opens, size).otherwise(state["used"] + size)
        return F.struct(bucket.alias("bucket"), used.alias("used"), F.concat(state["out"], F.array(bucket)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("bucket"), F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sizes, start, step, lambda s: s["out"])

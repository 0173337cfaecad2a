"""Centroid clustering by annulus search.

Centroids are sorted by their norms. A vector that lies at distance u from some centroid can only be nearer to, or as
near to, centroids whose norms differ from its own by u at most: two binary searches give that stretch of the sorted
centroids, and only those are compared, exactly, ties on the border included. u is the distance to the centroid that
the vector had the round before, in the first round to the one whose norm is closest.

Vectors are integers. A round is one pass over a table, without a shuffle of vectors: each task assigns its vectors and
adds up what it has, and only those sums (one a centroid and component) are shuffled. The centroids themselves are a
parameter's size, so driver and tasks hold all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Integers of this size or more go through Python's own, which are exact at any size.
WIDE = 1 << 24
#: Pairs of a vector and a centroid that are compared at once.
PAIRS = 1 << 14
#: Most components of all centroids together.
MAX_COMPONENTS = 1 << 24
#: Sums are written in digits of this many bits, so that they are exact at any size.
DIGIT = 32
MOST = (1 << 63) - 1

SCHEMA = "vec_id long, small array<int>, wide array<double>, cluster int, distance long, digit int, rows long, sums array<long>"


def quantised(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, small (integers floor(scale * x)), wide (what is to be scaled, where one is WIDE or more; else null) of the
    vectors of table (vec_id, embedding) with dims components, none of them null, infinite or not a number. scale is a
    power of two, so that scaling is exact."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.size("embedding") == dims
    odd = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == math.inf))
    large = F.exists("x", lambda e: F.abs(e) >= WIDE // scale - 1)
    kept = table.where(whole & ~odd).select("vec_id", x.alias("x"))
    return kept.select("vec_id", F.when(~large, F.transform("x", lambda e: F.floor(e * scale).cast("int"))).alias("small"), F.when(large, F.col("x")).alias("wide"))


def integers(wide: list[float], scale: int) -> list[int]:
    """floor(scale * x), exactly."""
    out = []
    for x in wide:
        over, under = x.as_integer_ratio()
        out.append(over * scale // under)
    return out


def _root(n: int) -> float:
    return math.sqrt(n) if n < 1 << 1000 else math.inf


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) if squares.dtype != object else np.array([_root(int(n)) for n in squares])


def _squares(q: np.ndarray) -> np.ndarray:
    return (q * q).sum(axis=1)


class Centroids:
    """Centroids in the order of their norms."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        norms = [_root(sum(x * x for x in r)) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: (norms[i], i))
        kind = object if any(abs(x) >= WIDE for r in rows for x in r) else np.int64
        self.order = np.array(order, np.int64)
        self.place = np.argsort(self.order)
        self.norms = np.array([norms[i] for i in order])
        self.values = np.array([rows[i] for i in order], kind)

    def nearest(self, q: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each row of q, the smallest of several, and its squared distance; how many pairs
        were compared. last: the row's centroid before, or -1."""
        values = self.values if q.dtype == self.values.dtype else self.values.astype(object)
        q = q if q.dtype == values.dtype else q.astype(object)
        norm = _roots(_squares(q))
        near = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        first = np.where(last >= 0, self.place[last], near)
        bound = _roots(_squares(q - values[first]))
        # rounding moves norms and bounds by some 1e-16 of their size
        reach = bound + (norm + bound) * 1e-9 + 1e-9
        sure = np.isfinite(norm) & np.isfinite(reach)
        with np.errstate(invalid="ignore"):
            low = np.where(sure, np.searchsorted(self.norms, norm - reach, "left"), 0)
            high = np.where(sure, np.searchsorted(self.norms, norm + reach, "right"), len(self.norms))
        found, distance, step = np.zeros(len(q), np.int64), np.zeros(len(q), q.dtype), 0
        width = high - low
        while step < len(q):
            ends = np.cumsum(width[step : step + PAIRS])
            n = max(1, int(np.searchsorted(ends, PAIRS, "right")))
            count, ends = width[step : step + n], ends[:n]
            starts = ends - count
            row = np.repeat(np.arange(n), count)
            which = np.arange(ends[-1]) - starts[row] + low[step : step + n][row]
            d = _squares(q[step + row] - values[which])
            least = np.minimum.reduceat(d, starts)
            number = np.where(d == least[row], self.order[which], len(self.order))
            found[step : step + n], distance[step : step + n] = np.minimum.reduceat(number, starts), least
            step += n
        return found, distance, int(width.sum())


def _rows(b: pa.RecordBatch, scale: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, vectors) of a batch: first those of small integers, then the others."""
    small, wide = b.column("small"), b.column("wide")
    is_small = np.array(small.is_valid())
    if is_small.any():
        yield np.flatnonzero(is_small), small.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
    if not is_small.all():
        rows = [integers(x, scale) for x in wide.to_pylist() if x is not None]
        yield np.flatnonzero(~is_small), np.array(rows, object).reshape(-1, dims)


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vectors (vec_id, small, wide, cluster: that of the round before, or -1) with cluster and distance (squared; at most
    what 64 bits hold); and, as rows with sums, what each task adds up: for each centroid and each digit of the sums the
    sums of the components, with the number of rows at the first digit."""
    k, dims = len(centroids), len(centroids[0])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_, totals, counts = Centroids(centroids), np.zeros((k, dims), object), np.zeros(k, np.int64)
        for b in batches:
            cluster, distance, last = np.zeros(b.num_rows, np.int32), [0] * b.num_rows, b.column("cluster").to_numpy(zero_copy_only=False)
            for at, q in _rows(b, scale, dims):
                found, d, _ = sorted_.nearest(q, last[at])
                cluster[at] = found
                for i, x in zip(at.tolist(), d.tolist(), strict=True):
                    distance[i] = min(x, MOST)
                counts += np.bincount(found, minlength=k)
                for c in np.unique(found).tolist():
                    totals[c] += q[found == c].sum(axis=0).astype(object)
            none = lambda kind: pa.nulls(b.num_rows, kind)
            columns = [b.column("vec_id"), b.column("small"), b.column("wide"), pa.array(cluster), pa.array(distance, pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)
        of, digits, sizes, sums = [], [], [], []
        for c in np.flatnonzero(counts).tolist():
            left, digit = [int(x) for x in totals[c]], 0
            while digit == 0 or any(left):
                of.append(c)
                digits.append(digit)
                sizes.append(int(counts[c]) if digit == 0 else 0)
                sums.append([(abs(x) & ((1 << DIGIT) - 1)) * (1 if x >= 0 else -1) for x in left])
                left, digit = [(abs(x) >> DIGIT) * (1 if x >= 0 else -1) for x in left], digit + 1
        none = lambda kind: pa.nulls(len(of), kind)
        columns = [none(pa.int64()), none(pa.list_(pa.int32())), none(pa.list_(pa.float64())), pa.array(of, pa.int32()), none(pa.int64()), pa.array(digits, pa.int32()), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return vectors.select("vec_id", "small", "wide", "cluster").mapInArrow(go, SCHEMA)


def moved(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of what is assigned to each centroid; one without vectors stays."""
    parts = assigned.where("sums is not null").select("cluster", "digit", "rows", F.posexplode("sums").alias("at", "sum"))
    parts = parts.groupBy("cluster", "digit", "at").agg(F.sum("rows").alias("rows"), F.sum("sum").alias("sum"))
    sums, counts = [[0] * len(c) for c in centroids], [0] * len(centroids)
    for r in parts.toLocalIterator():
        sums[r["cluster"]][r["at"]] += r["sum"] << (DIGIT * r["digit"])
        if r["at"] == 0:
            counts[r["cluster"]] += r["rows"]
    return [[x // n for x in s] if n else c for s, n, c in zip(sums, counts, centroids, strict=True)]


@dataclass(frozen=True)
class Clusters:
    """rows: vec_id, small, wide, cluster, distance; the final centroids by number."""

    rows: DataFrame
    centroids: list[list[int]]


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the least SHA-256 of seed:vec_id in hexadecimal; equal ids come in the order of their components,
    a null id is written as nothing."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    drawn = vectors.select(key.alias("key"), "small", "wide").orderBy("key", "small", "wide").limit(k).collect()
    return [list(r["small"]) if r["small"] is not None else integers(r["wide"], scale) for r in drawn]


def cluster(table: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int) -> Clusters:
    """k centroids of table (vec_id, embedding) after so many rounds, and every vector's nearest.

    Vectors that are null, of another length, or hold a null, infinite or missing number take no part. Rows that repeat
    count each for itself; a null id is an id like any other. Fewer than k vectors give as many centroids; none gives no
    row. Distances beyond 64 bits are compared exactly and given as the greatest such number.
    """
    if k * dims > MAX_COMPONENTS:
        raise ValueError(f"{k} centroids of {dims} components: more than {MAX_COMPONENTS}")
    scratch = Scratch(table.sparkSession, "annulus")
    vectors = scratch.table(quantised(table, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, seed, scale)
    now = vectors.withColumn("cluster", F.lit(-1))
    if not centroids:
        return Clusters(now.withColumn("distance", F.lit(0).cast("long")), [])
    for turn in range(rounds + 1):
        done = scratch.table(assign(now, centroids, scale), f"round{turn}")
        scratch.drop("vectors" if turn == 0 else f"round{turn - 1}")
        now = done.where("sums is null")
        if turn < rounds:
            centroids = moved(done, centroids)
    return Clusters(now.select("vec_id", "small", "wide", "cluster", "distance"), centroids)


def digest(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia (sums of distances, at most what 64 bits hold), centroid_sha256 (of
    the components in decimal, joined by commas)."""
    spark = found.rows.sparkSession
    cut = lambda c: F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_cluster = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum"))
    # one row a centroid, whose number is a parameter
    sums = {r["cluster"]: int(r["sum"]) for r in by_cluster.collect()}
    total = min(sum(sums.values()), MOST)
    names = [(c, min(sums.get(c, 0), MOST), total, sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(found.centroids)]
    of = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

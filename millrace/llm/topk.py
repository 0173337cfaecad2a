"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are sorted by length and cut into runs; a run holds buckets of like length. A query that already has k
scores of at least s needs candidates p with cos(q, p) >= s / (|q| |p|) only, so for a bucket with greatest length l
the local threshold is s / (|q| l): above 1 the bucket can't hold any, and with it all later ones of the run.
Candidates shorter than s / |q|, the tail of a bucket, go by length. The others are pruned by coordinate: the products
over the coordinates F that hold most of the queries' weight are found first, as many as the local thresholds call
for; the rest can add |q_rest| |p_rest| at most, so pairs that stay below s with that are out. What is left is
verified by the exact integer product.

A first join takes every query through the run of longest vectors; its k-th score is the threshold with which it
meets the other runs, or skips them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, global_rank

K = 20
#: Numbers in the vectors of one run, and of the queries that meet it together: those of a task's two sides.
RUN_NUMBERS, QUERY_NUMBERS = 1 << 20, 1 << 20
#: Candidates of a bucket, and queries that are held against it at once.
BUCKET, AT_ONCE = 1_024, 512
#: Most lengths of runs that are broadcast; with more runs only every so many of them is.
MAX_MARKS = 65_536
SLACK = 1e-9
LEAST, MOST = -(1 << 63), (1 << 63) - 1
NAMELESS = MOST  # sorts last, with a mark of its own


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, all pairs: exact doubles where all sums are below 2**53, else Python's integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1] < 2.0**53:
        return q @ p.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(p).T


def _long(score: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what is beyond them becomes the greatest or least of them."""
    if score.dtype == object:
        return np.array([min(max(x, LEAST), MOST) for x in score.ravel()], np.int64).reshape(score.shape)
    return score.astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(x).max(axis=1, initial=0), 1.0)
    with np.errstate(over="ignore"):
        return np.linalg.norm(x / top[:, None], axis=1) * top


class Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int, least: int | None):
        self.k, self.least = k, least  # least: a score that k candidates are known to reach
        self.score, self.id, self.nameless = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        score, ids, nameless = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.nameless, nameless])
        order = np.lexsort((nameless, ids, ~score))[: self.k]  # ~ falls as the score rises, for the least number too
        self.score, self.id, self.nameless = score[order], ids[order], nameless[order]
        if len(order) == self.k and (self.least is None or self.score[-1] > self.least):
            self.least = int(self.score[-1])


def _focus(q: np.ndarray, b: np.ndarray, local: np.ndarray) -> np.ndarray:
    """The coordinates that are multiplied first: by falling weight in the queries, until what the rest of a typical
    pair can add is half of the typical local threshold. All of them if that takes nearly all."""
    weight = (q**2).sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    left_q = 1 - np.cumsum(weight[order]) / max(weight.sum(), 1e-300)
    in_b = (b**2).sum(axis=0)[order]
    left_b = 1 - np.cumsum(in_b) / max(in_b.sum(), 1e-300)
    adds = np.sqrt(np.maximum(left_q, 0) * np.maximum(left_b, 0))
    n = int(np.searchsorted(-adds, -0.8 * float(np.median(local)), side="left")) + 1
    return order[: n if n <= 0.95 * len(order) else len(order)]


def search_run(queries: dict, candidates: dict, k: int, tally: dict | None = None) -> dict:
    """Best k of one run for each query: row of the query, vec_id, nameless, score.

    queries: x, row, least (-1 in `told` where it isn't known); candidates: x, row, id, nameless. tally counts all
    pairs and those whose whole product was found.
    """
    q, p = queries["x"], candidates["x"]
    p_norm = _lengths(p)
    order = np.lexsort((candidates["id"], -p_norm))
    p, p_norm, p_id, p_row, p_none = p[order], p_norm[order], candidates["id"][order], candidates["row"][order], candidates["nameless"][order]
    q_norm, q_row = _lengths(q), queries["row"]
    best = [Best(k, int(x) if known else None) for x, known in zip(queries["least"], queries["told"], strict=True)]
    for at in range(0, len(p), BUCKET):
        b, b_norm = p[at : at + BUCKET], p_norm[at : at + BUCKET]
        ids, rows, none = p_id[at : at + BUCKET], p_row[at : at + BUCKET], p_none[at : at + BUCKET]
        for start in range(0, len(q), AT_ONCE):
            here = np.arange(start, min(start + AT_ONCE, len(q)))
            least = np.array([-np.inf if best[i].least is None else float(best[i].least) for i in here])
            need = q_norm[here] * b_norm[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(least > 0, least / need, -1.0)
            if tally is not None:
                tally["pairs"] += len(here) * len(b)
            here, least, local = (x[~(local > 1 + SLACK)] for x in (here, least, local))
            bounded = local > 0  # a threshold that every candidate may reach prunes nothing
            for some, prune in ((~bounded, False), (bounded, True)):
                if not some.any():
                    continue
                mine, bar = here[some], least[some]
                n = len(b)
                if prune:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        shortest = np.nanmin(bar / q_norm[mine]) * (1 - SLACK)
                    n = int(np.searchsorted(-b_norm, -shortest, side="right"))
                i, j, score = _meet(q[mine], b[:n], bar, local[some] if prune else None, tally)
                keep = (q_row[mine[i]] != rows[j]) & ~(score < bar[i])
                i, j, score = i[keep], j[keep], score[keep]
                edges = np.searchsorted(i, np.arange(len(mine) + 1))
                for m in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[m], edges[m + 1])
                    best[mine[m]].add(score[part], ids[j[part]], none[j[part]])
    size = [len(f.id) for f in best]
    join = lambda of, kind: np.concatenate([of(f) for f in best]) if best else np.zeros(0, kind)
    return {"query_row": np.repeat(q_row, size), "vec_id": join(lambda f: f.id, np.int64), "nameless": join(lambda f: f.nameless, bool), "score": join(lambda f: f.score, np.int64)}


def _meet(q: np.ndarray, b: np.ndarray, bar: np.ndarray, local: np.ndarray | None, tally: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate) in order of query that can reach the bar, with their scores."""
    first = _focus(q, b, local) if local is not None and len(b) else np.arange(q.shape[1])
    rest = np.setdiff1d(np.arange(q.shape[1]), first)
    score = _products(q[:, first], b[:, first])
    if not len(rest):
        if tally is not None:
            tally["verified"] += score.size
        score = _long(score)
        i, j = np.nonzero(~(score < bar[:, None]))
        return i, j, score[i, j]
    q_rest, b_rest = q[:, rest], b[:, rest]
    reach = np.outer(_lengths(q_rest), _lengths(b_rest)) * (1 + SLACK)
    i, j = np.nonzero(~(score.astype(np.float64) + reach < bar[:, None] - SLACK * np.abs(bar[:, None])))
    if tally is not None:
        tally["verified"] += len(i)
    if len(i) > score.size // 2:  # whole matrices are quicker
        score = _long(score + _products(q_rest, b_rest))
        return i, j, score[i, j]
    if score.dtype == object or float(np.abs(q).max(initial=0)) * float(np.abs(b).max(initial=0)) * q.shape[1] >= 2.0**53:
        whole = np.frompyfunc(int, 1, 1)
        more = (whole(q_rest[i]) * whole(b_rest[j])).sum(axis=1) if len(i) else np.zeros(0, object)
        return i, j, _long(np.frompyfunc(int, 1, 1)(score[i, j]) + more)
    return i, j, _long(score[i, j] + np.einsum("ij,ij->i", q_rest[i], b_rest[j]))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows, filled up with 0."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every query among vectors (vec_id, x).

    x: array<double> of whole numbers. Every row but the query's own is a candidate, also one with the same vec_id or
    with none. Ties go to the smaller vec_id, null last. Null vectors take no part; a missing component counts as 0.
    Scores are exact; one beyond 64 bits counts as the greatest or least such number. Fewer candidates than k give
    fewer rows, no query or no other row gives none.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    top = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)))
    square = F.aggregate("x", F.lit(0.0), lambda s, e: s + (e / F.col("top")) * (e / F.col("top")))
    x = F.transform("x", lambda e: F.coalesce(e, F.lit(0.0)))
    rows = vectors.where(F.col("x").isNotNull()).select("vec_id", x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.select("vec_id", "x", top.alias("top"), "asks")
    rows = scratch.table(rows.select("vec_id", "x", (F.sqrt(square) * F.col("top")).alias("norm"), "asks"), "rows")
    ranked = global_rank(scratch, rows, [F.col("norm").desc(), F.col("vec_id").asc_nulls_last(), F.col("x").asc()], "ranked", into="row")
    facts = rows.agg(F.max(F.size("x")).alias("width"), F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    width = max(1, facts["width"] or 0)
    size, together = max(1, RUN_NUMBERS // width), max(1, QUERY_NUMBERS // width)
    ranked = scratch.table(ranked.withColumn("run", F.floor(F.col("row") / size)), "runs")
    groups, runs = max(1, -(-facts["asked"] // together)), -(-facts["n"] // size)
    queries = ranked.where("asks").select("row", F.col("vec_id").alias("query_id"), "x", "norm", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"))
    found = "query_row long, vec_id long, nameless boolean, score long"

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        none = lambda t, c: t[c].is_null().to_numpy()
        filled = lambda t, c, x: t[c].fill_null(x).to_numpy()
        asks = {"x": _matrix(left["x"], width), "row": left["row"].to_numpy(), "least": filled(left, "least", 0), "told": ~none(left, "least")}
        held = {"x": _matrix(right["x"], width), "row": right["row"].to_numpy(), "id": filled(right, "vec_id", NAMELESS), "nameless": none(right, "vec_id")}
        return pa.table(search_run(asks, held, k))

    def meet(queries: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
        """chosen: pairs (grp, run) to join."""
        pairs = scratch.table(chosen, f"{name}_pairs")
        a = queries.join(pairs, "grp").select(*[F.col(c).alias(c) for c in ("grp", "run", "row", "x", "least")])
        b = ranked.join(pairs, "run").select("grp", "run", "row", "vec_id", "x")
        return scratch.table(a.groupBy("grp", "run").cogroup(b.groupBy("grp", "run")).applyInArrow(go, found), name)

    every = scratch.spark.range(groups).select(F.col("id").alias("grp"))
    first = meet(queries.withColumn("least", F.lit(None).cast("long")), every.withColumn("run", F.lit(0).cast("long")), "first")
    known = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    told = scratch.table(queries.join(known, "row", "left"), "told")
    # a group skips a run if none of its queries can reach its k-th score there; runs come in order of falling length
    bar = F.when(F.col("least").isNull() | (F.col("least") <= 0) | (F.col("norm") == 0), 0.0).otherwise(F.col("least") / F.col("norm"))
    step = max(1, -(-runs // MAX_MARKS))
    marks = ranked.where((F.col("run") > 0) & ((F.col("run") - 1) % step == 0)).groupBy("run").agg(F.max("norm").alias("longest"))
    shared = scratch.spark.sparkContext.broadcast(marks.orderBy("run").toPandas()["longest"].to_numpy())  # MAX_MARKS numbers at most

    @F.pandas_udf("long")
    def runs_needed(bars: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(step * np.searchsorted(-shared.value, -bars.to_numpy() * (1 - SLACK), side="right"), runs - 1))

    groups_need = told.groupBy("grp").agg(F.min(bar).alias("bar")).select("grp", runs_needed("bar").alias("n"))
    rest = groups_need.where("n > 0").select("grp", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("run"))
    second = meet(told, rest, "second")
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), "nameless", "vec_id")
    ranks = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query_row"), "query_id")
    return ranks.join(named, "query_row").select("query_id", "rank", F.when(~F.col("nameless"), F.col("vec_id")).alias("vec_id"), "score")


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, x: floor(scale * component) of embeddings (vec_id, embedding) as doubles, which hold whole numbers of any
    size; null where a component or its multiple is null or not finite."""
    scaled = F.transform("embedding", lambda e: e.cast("double") * F.lit(float(scale)))
    finite = F.forall(scaled, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # from 2**52 on every double is whole
    x = F.transform(scaled, lambda e: F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e))
    return embeddings.select("vec_id", F.when(finite, x).alias("x"))

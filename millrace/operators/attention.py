"""Attention over bounded windows of rows, and the pieces that tiled attention merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import vectors as v

#: Rows of a window and of a tile.
WINDOW, TILE = 64, 16


def windows(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """seq, pos, x of rows (id, x): ids size by size make a window."""
    return rows.select(F.floor(F.col("id") / size).cast("long").alias("seq"), F.pmod("id", F.lit(size)).cast("long").alias("pos"), "x")


def attend(q: np.ndarray, k: np.ndarray, values: np.ndarray, seen: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and log-sum-exp of each query, keys taken tile by tile: no more than a tile of scores at once.

    The state of a query is (greatest score, sum of powers, weighted sum); two states merge by scaling both to the
    greater of their maxima. seen[i, j]: query i looks at key j.
    """
    n, d = q.shape
    top, mass, out = np.full(n, -np.inf), np.zeros(n), np.zeros((n, values.shape[1]))
    for at in range(0, len(k), tile):
        scores = np.where(seen[:, at : at + tile], q @ k[at : at + tile].T / np.sqrt(d), -np.inf)
        new = np.maximum(top, scores.max(axis=1))
        base = np.where(np.isinf(new), 0.0, new)
        old, powers = np.exp(np.where(np.isinf(top), -np.inf, top - base)), np.exp(scores - base[:, None])
        mass = mass * old + powers.sum(axis=1)
        out = out * old[:, None] + powers @ values[at : at + tile]
        top = new
    return out / mass[:, None], top + np.log(mass)


def backward(q: np.ndarray, k: np.ndarray, values: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of q, k and values; powers are made again from the log-sum-exp instead of being kept."""
    out, lse = attend(q, k, values, seen)
    scale = 1 / np.sqrt(q.shape[1])
    p = np.where(seen, np.exp(q @ k.T * scale - lse[:, None]), 0.0)
    along = (grad * out).sum(axis=1)
    ds = p * (grad @ values.T - along[:, None]) * scale
    return ds @ k, ds.T @ q, p.T @ grad


def self_attention(rows: DataFrame, causal: bool, tile: int = TILE) -> DataFrame:
    """seq, pos, out, lse of windows (seq, pos, x), each row being query, key and value. Windows are bounded groups."""

    def go(w: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values("pos")
        x = np.array(list(w["x"]), np.float64)
        pos = w["pos"].to_numpy()
        seen = pos[None, :] <= pos[:, None] if causal else np.ones((len(x), len(x)), bool)
        out, lse = attend(x, x, x, seen, tile)
        return pd.DataFrame({"seq": w["seq"].to_numpy(), "pos": pos, "out": list(out), "lse": lse})

    return rows.groupBy("seq").applyInPandas(go, "seq long, pos long, out array<double>, lse double")


def self_attention_backward(rows: DataFrame, causal: bool) -> DataFrame:
    """seq, pos, dq, dk, dv of windows (seq, pos, x, grad), each row being query, key and value; grad: of the output."""

    def go(w: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values("pos")
        x, grad = (np.array(list(w[c]), np.float64) for c in ("x", "grad"))
        pos = w["pos"].to_numpy()
        seen = pos[None, :] <= pos[:, None] if causal else np.ones((len(x), len(x)), bool)
        return pd.DataFrame({"seq": w["seq"].to_numpy(), "pos": pos, **dict(zip(("dq", "dk", "dv"), map(list, backward(x, x, x, seen, grad)), strict=True))})

    return rows.groupBy("seq").applyInPandas(go, "seq long, pos long, dq array<double>, dk array<double>, dv array<double>")


def self_attention_builtin(rows: DataFrame, causal: bool) -> DataFrame:
    """The same by built-in functions: the window's rows as an array beside each of its rows, at most WINDOW long."""
    keys = rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("keys"))
    both = rows.join(keys, "seq")
    seen = F.filter("keys", lambda k: k["pos"] <= F.col("pos")) if causal else F.col("keys")
    scores = F.transform("seen", lambda k: v.dot(F.col("x"), k["x"]) / F.sqrt(F.size("x")))
    scored = both.withColumn("seen", seen).withColumn("scores", scores)
    width = F.sequence(F.lit(1), F.size("x"))

    def outputs(shares: Column) -> Column:
        of = lambda c: F.aggregate(F.zip_with("seen", shares, lambda k, s: F.element_at(k["x"], c) * s), F.lit(0.0), lambda a, b: a + b)
        return F.transform(width, of)

    return scored.select("seq", "pos", tx.let(v.softmax(F.col("scores")), outputs).alias("out"), v.log_sum_exp(F.col("scores")).alias("lse"))

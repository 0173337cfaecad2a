"""Numeric expressions of language models on arrays of doubles. All are built-in functions, evaluated in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def log_sum_exp(x: Column) -> Column:
    """Shifted by the maximum, so that large values don't overflow."""
    return let(F.array_max(x), lambda top: top + F.log(total(F.transform(x, lambda e: F.exp(e - top)))))


def softmax(x: Column) -> Column:
    return let(log_sum_exp(x), lambda lse: F.transform(x, lambda e: F.exp(e - lse)))


def log_softmax(x: Column) -> Column:
    return let(log_sum_exp(x), lambda lse: F.transform(x, lambda e: e - lse))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target], target counted from 0."""
    return log_sum_exp(logits) - F.element_at(logits, target.cast("int") + 1)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def silu(x: Column) -> Column:
    return F.transform(x, lambda e: e * sigmoid(e))


def rms_norm(x: Column, weight: list[float] | None = None, eps: float = 1e-5) -> Column:
    scale = F.sqrt(total(F.transform(x, lambda e: e * e)) / F.size(x) + eps)
    if weight is None:
        return let(scale, lambda s: F.transform(x, lambda e: e / s))
    return let(scale, lambda s: F.zip_with(x, constants(weight), lambda e, w: e / s * w))


def constants(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def linear(x: Column, weight: list[list[float]]) -> Column:
    """weight * x, one output for each row of weight."""
    return F.array(*[dot(x, constants(row)) for row in weight])


def swiglu(x: Column, w1: list[list[float]], w2: list[list[float]], w3: list[list[float]]) -> Column:
    """w2 (silu(w1 x) * w3 x)."""
    gate = F.zip_with(silu(linear(x, w1)), linear(x, w3), lambda a, b: a * b)
    return linear(gate, w2)


def rope(x: Column, position: Column, theta: float = 10_000.0) -> Column:
    """Turn each pair (2 i, 2 i + 1) by position / theta ** (2 i / size)."""

    def turned(e: Column, k: Column) -> Column:
        pair = k - k % 2
        angle = position / F.pow(F.lit(theta), pair / F.size(x))
        other = F.element_at(x, (F.when(k % 2 == 0, k + 1).otherwise(k - 1) + 1).cast("int"))
        return e * F.cos(angle) + F.when(k % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return F.transform(x, turned)


def temperature(x: Column, t: float) -> Column:
    """Logits over the temperature; one that isn't positive counts as 1e-8."""
    return F.transform(x, lambda e: e / F.lit(t if t > 0 else 1e-8))


def cosine_schedule(step: Column, top: float, low: float, warmup: int, cycle: int) -> Column:
    """Learning rate: linear up to `top` at warmup, half a cosine down to `low` at cycle, then `low`."""
    along = (step - warmup) / F.lit(float(cycle - warmup))
    down = F.lit(low) + (F.lit(1.0) + F.cos(along * math.pi)) * F.lit(0.5 * (top - low))
    return F.when(step < warmup, step / F.lit(float(warmup)) * top).when(step <= cycle, down).otherwise(F.lit(low))


def adamw(p: Column, g: Column, m: Column, v: Column, t: Column, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.01) -> Column:
    """One step: struct (p, m, v, t). t is the number of the step from 1; weights decay after the update."""
    m2, v2 = m * b1 + g * (1 - b1), v * b2 + g * g * (1 - b2)
    rate = F.lit(lr) * F.sqrt(F.lit(1.0) - F.pow(F.lit(b2), t)) / (F.lit(1.0) - F.pow(F.lit(b1), t))
    moved = p - rate * m2 / (F.sqrt(v2) + eps)
    return F.struct((moved - moved * (lr * decay)).alias("p"), m2.alias("m"), v2.alias("v"), t.alias("t"))

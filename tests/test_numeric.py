import math

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import vectors as v
from millrace.operators import attention, distributed


def one(spark, column, x, **more):
    return np.array(spark.createDataFrame([(x, *more.values())], ["x", *more]).select(column.alias("r")).first()["r"])


def test_vectors(spark):
    x = np.array([0.5, -1.0, 2.0, 100.0])
    soft = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    assert np.allclose(one(spark, v.softmax(F.col("x")), x.tolist()), soft)
    assert np.allclose(one(spark, v.log_softmax(F.col("x")), (x * 1000).tolist())[3], 0)
    assert np.isclose(one(spark, v.cross_entropy(F.col("x"), F.lit(2)), x.tolist()), -np.log(soft[2]))
    assert np.allclose(one(spark, v.silu(F.col("x")), x.tolist()), x / (1 + np.exp(-x)))
    assert np.allclose(one(spark, v.rms_norm(F.col("x"), [1, 2, 3, 4]), x.tolist()), x / np.sqrt((x**2).mean() + 1e-5) * [1, 2, 3, 4])
    angle = 3 / 10_000 ** (np.array([0, 0, 2, 2]) / 4)
    turned = x * np.cos(angle) + np.array([-x[1], x[0], -x[3], x[2]]) * np.sin(angle)
    assert np.allclose(one(spark, v.rope(F.col("x"), F.lit(3)), x.tolist()), turned)
    w1, w2, w3 = (np.arange(12).reshape(3, 4) / 20 + s for s in (0, 0, -0.2))
    w2 = w2.T
    gate = w1 @ x
    want = w2 @ (gate / (1 + np.exp(-gate)) * (w3 @ x))
    assert np.allclose(one(spark, v.swiglu(F.col("x"), w1.tolist(), w2.tolist(), w3.tolist()), x.tolist()), want)
    assert np.allclose(one(spark, v.temperature(F.col("x"), 0.0), [1.0]), [1e8])


def test_schedule_and_step(spark):
    rates = [r["r"] for r in spark.range(25).select(v.cosine_schedule(F.col("id"), 1.0, 0.1, 7, 21).alias("r")).collect()]
    want = [t / 7 if t < 7 else 0.1 + 0.45 * (1 + math.cos((t - 7) / 14 * math.pi)) if t <= 21 else 0.1 for t in range(25)]
    assert np.allclose(rates, want)
    p, g, m, s, lr, wd = 1.0, 0.5, 0.1, 0.2, 0.01, 0.1
    m2, s2 = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
    q = p - lr * math.sqrt(1 - 0.999**3) / (1 - 0.9**3) * m2 / (math.sqrt(s2) + 1e-8)
    r = spark.range(1).select(v.adamw(F.lit(p), F.lit(g), F.lit(m), F.lit(s), F.lit(3), lr, decay=wd).alias("s")).first()["s"]
    assert np.allclose([r["p"], r["m"], r["v"]], [q - lr * wd * q, m2, s2])


def test_tiled_attention_and_its_gradient():
    rng = np.random.default_rng(0)
    q, k, val, grad = (rng.normal(size=(12, 4)) for _ in range(4))
    for causal in (False, True):
        seen = np.tril(np.ones((12, 12), bool)) if causal else np.ones((12, 12), bool)
        s = np.where(seen, q @ k.T / 2, -np.inf)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        out, lse = attention.attend(q, k, val, seen, tile=5)
        assert np.allclose(out, p @ val) and np.allclose(lse, np.log(np.exp(s).sum(1)))
        dq, dk, dv = attention.backward(q, k, val, seen, grad)
        for x, dx in ((q, dq), (k, dk), (val, dv)):
            bump = np.zeros_like(x)
            bump[3, 1] = 1e-6
            move = lambda y: (attention.attend(*[y if z is x else z for z in (q, k, val)], seen)[0] * grad).sum()  # noqa: B023, E731
            assert np.isclose((move(x + bump) - move(x - bump)) / 2e-6, dx[3, 1], atol=1e-5)


def test_workers(spark):
    grads = spark.createDataFrame([(0, "w", 0, 1.0), (1, "w", 0, 3.0), (1, "w", 1, 4.0)], "rank int, param string, idx long, grad double")
    assert {(r["param"], r["idx"]): r["grad"] for r in distributed.mean_gradients(grads).collect()} == {("w", 0): 2.0, ("w", 1): 2.0}
    assert np.isclose(sum(r["grad"] ** 2 for r in distributed.clipped(grads, 1.0).collect()), 1.0, atol=1e-5)
    assert [r["grad"] for r in distributed.clipped(grads, 100.0).orderBy("rank", "idx").collect()] == [1.0, 3.0, 4.0]
    shapes = spark.createDataFrame([("embed", [10, 4]), ("w", [4, 4])], "name string, shape array<long>")
    assert tuple(distributed.parameter_count(shapes).first()) == (56, 16)

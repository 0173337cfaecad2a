import math
import random
from fractions import Fraction
from hashlib import sha256

import duckdb
import numpy as np

from millrace.llm import annulus, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, cluster int, distance long, key string, small int, sums int"


def plain(rows, k, rounds, dims, scale, seed):
    """Every vector against every centroid with Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    if not kept:
        return []
    for turn in range(rounds + 1):
        of = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    cut = lambda x: min(x, annulus.MOST)
    inertia = {j: sum(cut(d) for d, c in of if c == j) for j in range(len(centroids))}
    return [(i, c, cut(d), cut(inertia[c]), cut(sum(inertia.values())), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, of, strict=True)]


def digest(table, **how):
    return sorted((tuple(r) for r in annulus.digest(annulus.cluster(table, **how)).collect()), key=str)


def rows_of(kind):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 1) * (1 + i % 3) for _ in range(3)]) for i in range(300)]
    rows += [(i, [float(i % 2), 0.0, -0.001]) for i in range(300, 360)]  # ties and repeats
    rows += [(7, rows[7][1]), (None, [1.0, 2.0, 3.0]), (None, None), (800, [1.0, None, 2.0]), (801, [math.inf, 0.0, 0.0]), (802, [math.nan, 0.0, 0.0]), (803, []), (804, [1.0]), (805, [0.0, 0.0, 0.0])]
    if kind == "wide":
        rows += [(900 + i, [1e30 * i, -3e18, 1.5e308]) for i in range(5)] + [(910 + i, [70000.0 + i, -1e7, 2.0**40]) for i in range(9)]
    return rows


def test_odd_rows_against_plain_rounds(spark):
    for kind in ("plain", "wide"):
        table = spark.createDataFrame([(*r, 1, 1, "x", 1, 1) for r in rows_of(kind)], SCHEMA)
        for k in (1, 7, 25):
            how = {"k": k, "rounds": 3, "dims": 3, "scale": 256, "seed": 2}
            assert digest(table, **how) == sorted(plain(rows_of(kind), **how), key=str)
    assert digest(table.limit(0), **how) == []


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-0.5, 0.25])]
    how = {"k": 9, "rounds": 2, "dims": 2, "scale": 4, "seed": 0}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert digest(table, **how) == sorted(plain(rows, **how), key=str)


def test_only_the_annulus_is_compared():
    rng = np.random.default_rng(1)
    directions = rng.normal(size=(2000, 8))
    q = np.floor(directions / np.linalg.norm(directions, axis=1, keepdims=True) * rng.integers(1, 100, 2000)[:, None] * 100).astype(np.int64)
    found = annulus.Centroids(q[:200].tolist())
    cluster, distance, pairs = found.nearest(q, np.full(2000, -1))
    every = ((q[:, None, :] - q[None, :200, :]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()
    assert pairs < 0.75 * 2000 * 200
    assert found.nearest(q, cluster)[2] < pairs  # a tighter bound


def test_query_has_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op13_annulus"])
    columns = [c[0] for c in want.description]
    found = queries.op13_annulus(spark, SF).select(*columns).collect()
    assert sorted(tuple(r) for r in found) == sorted(want.fetchall())

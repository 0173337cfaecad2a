import itertools
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import sharding

from .data import empty, odd, odd_rows


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = cells[np.argsort(sharding.hilbert_index(cells.T, bits))]
        assert sorted(sharding.hilbert_index(cells.T, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_odd_rows(spark):
    rows = sharding.measured(odd(spark))
    found = sharding.hilbert_shards(rows, ["source", "lang", "size"], 8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    by = {s: sorted(r["slot"] for r in found if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.hilbert_shards(sharding.measured(empty(spark)), ["source", "lang", "size"]).count() == 0


def test_runs_can_be_pruned(spark):
    docs = spark.createDataFrame([(i, i * 37 % 1000, i * 91 % 1000, "hot" if i % 3 else f"s{i % 50}") for i in range(2000)], "doc_id long, x long, y long, source string")
    placed = sharding.hilbert_shards(docs, ["x", "y"], 16).cache()
    stats = sharding.manifest(placed, ["x", "y"]).cache()
    hit = sharding.prune(stats, {"x": (0, 99), "y": (0, 99)})
    need = {r["shard"] for r in placed.where("x < 100 and y < 100").collect()}
    assert need <= set(hit) and len(hit) <= 4
    again = sharding.hilbert_shards(docs.repartition(5), ["x", "y"], 16)
    assert again.select("doc_id", "shard", "slot").exceptAll(placed.select("doc_id", "shard", "slot")).count() == 0


def test_order_shards_and_slots_against_plain_sorting(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), ["a", "b", "hot", None][int(rng.choice(4, p=[0.2, 0.2, 0.5, 0.1]))], float(x) if x > -2 else None) for i, x in enumerate(rng.normal(size=600))]
    rows += [(None, "hot", 0.5)] * 3 + [(5, "hot", 0.5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, size double").withColumns({c: F.lit(1) for c in ("curve", "shard", "rank", "_m0", "a.b", "value")})
    found = [r.asDict() for r in sharding.hilbert_shards(docs, ["source", "size"], 7, bits=4).collect()]
    n = len(rows)
    # levels as the docstring has them: the middle of a value's rows among all, null being 0
    order = sorted(r[1] or "" for r in rows)
    middle = {v: (order.index(v) + order.count(v) / 2) * 16 // n for v in set(order)}
    of_source = {v: 0 if v == "" else min(15, int(m)) for v, m in middle.items()}
    # cuts of the sizes are quantiles, here read off the result: levels rise with size
    curve = {}
    for r in found:
        curve.setdefault((r["source"], r["size"]), set()).add(r["curve"])
    assert all(len(c) == 1 for c in curve.values())
    level = {(s, z): q for q in range(16) for (s, z), (c,) in ((k, tuple(v)) for k, v in curve.items()) if sharding.hilbert_index(np.array([[of_source[s or ""]], [q]]), 4)[0] == c}
    assert len(level) == len(curve)
    sizes = sorted((z, q) for (_, z), q in level.items() if z is not None)
    assert all(a[1] <= b[1] for a, b in zip(sizes, sizes[1:])) and len({q for _, q in sizes}) >= 14  # noqa: B905
    key = lambda r: (next(iter(curve[r["source"], r["size"]])), r["doc_id"] is not None, r["doc_id"] or 0)
    ranked = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert [key(r) for r in ranked] == sorted(key(r) for r in found)
    assert [(r["shard"], r["slot"]) for r in ranked] == [(k * 7 // n, k - -(-(k * 7 // n) * n // 7)) for k in range(n)]

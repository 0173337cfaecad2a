import numpy as np
from pyspark.sql import functions as F

from millrace.functions import vectors as v
from millrace.operators import distributed
from millrace.operators import transformer as tf
from millrace.sources import files

SHAPE = tf.Shape(vocab=50, context=16, width=16, layers=2, heads=4, hidden=24)


def plain(ids, w, s):
    """The same model, position by position and head by head."""
    norm = lambda x, g: x / np.sqrt((x**2).mean() + 1e-5) * g
    xs = [w["embedding"][i] for i in ids]
    size = s.width // s.heads
    for k in range(s.layers):
        hs = [norm(x, w[f"{k}.norm1"]) for x in xs]
        qs, ks, vs = ([w[f"{k}.{n}"] @ h for h in hs] for n in "qkv")
        new = []
        for i in range(len(ids)):
            out = []
            for head in range(s.heads):
                c = slice(head * size, (head + 1) * size)

                def turn(x, pos):
                    y = x.copy()
                    for j in range(0, size, 2):
                        a = pos / s.theta ** (j / size)
                        y[j], y[j + 1] = x[j] * np.cos(a) - x[j + 1] * np.sin(a), x[j] * np.sin(a) + x[j + 1] * np.cos(a)
                    return y

                sc = np.array([turn(qs[i][c], i) @ turn(ks[j][c], j) / np.sqrt(size) for j in range(i + 1)])
                p = np.exp(sc - sc.max())
                p /= p.sum()
                out.append(sum(p[j] * vs[j][c] for j in range(i + 1)))
            new.append(xs[i] + w[f"{k}.o"] @ np.concatenate(out))
        xs = []
        for x in new:
            h = norm(x, w[f"{k}.norm2"])
            g = w[f"{k}.w1"] @ h
            xs.append(x + w[f"{k}.w2"] @ (g / (1 + np.exp(-g)) * (w[f"{k}.w3"] @ h)))
    return np.array([w["output"] @ norm(x, w["final_norm"]) for x in xs])


def test_forward_and_losses(spark):
    w = tf.initial(SHAPE, 3)
    ids = [3, 1, 4, 1, 5, 9, 2, 6]
    want = plain(ids, w, SHAPE)
    assert np.allclose(tf.forward(np.array(ids), w, SHAPE), want)
    row = spark.createDataFrame([(ids[:-1], ids[1:])], "x array<int>, y array<int>")
    p = want[:-1] - np.log(np.exp(want[:-1]).sum(1, keepdims=True))
    assert np.isclose(tf.losses(row, w, SHAPE).first()["loss"], -p[np.arange(7), ids[1:]].mean())


def test_sampling(spark):
    rng = np.random.default_rng(0)
    logits = np.log(np.array([0.5, 0.25, 0.15, 0.1]))
    assert {tf.choose(logits, rng, top_p=0.6) for _ in range(200)} == {0, 1}
    assert {tf.choose(logits, rng, top_k=3) for _ in range(200)} == {0, 1, 2}
    assert {tf.choose(logits, rng, temperature=0.0) for _ in range(20)} == {0}
    w = tf.initial(SHAPE, 3)
    greedy = tf.generate([1, 2], w, SHAPE, 30, temperature=0.0)
    every = [1, 2, *greedy]
    assert len(greedy) == 30 and all(every[i] == tf.forward(np.array(every[max(0, i - 16) : i]), w, SHAPE)[-1].argmax() for i in range(2, 32))
    assert tf.generate([1, 2], w, SHAPE, 30, end=greedy[4], temperature=0.0) == greedy[: greedy.index(greedy[4]) + 1]
    found = tf.completions(spark.createDataFrame([(7, [1, 2])], "prompt_id long, ids array<int>"), w, SHAPE, 5)
    assert found.first()["new_ids"] == tf.generate([1, 2], w, SHAPE, 5, seed=7)


def test_sharded_step(spark):
    state = spark.createDataFrame([(n, i, float(i + 1), 0.0, 0.0, 0) for n in "abc" for i in range(3)], "param string, idx long, p double, m double, v double, t int")
    grads = spark.createDataFrame([(n, i, 0.1 * (i + 1)) for n in "ab" for i in range(3)], "param string, idx long, grad double")
    found = {(r["param"], r["idx"]): r for r in distributed.sharded_step(state, grads, 2, 0.01).collect()}
    whole = distributed.with_gradient(state, grads).select("param", "idx", v.adamw(F.col("p"), F.col("grad"), F.col("m"), F.col("v"), F.col("t") + 1, 0.01).alias("s"))
    for r in whole.collect():
        assert found[r["param"], r["idx"]]["p"] == r["s"]["p"] and found[r["param"], r["idx"]]["t"] == 1
    assert found["c", 1]["p"] == 2.0 and found["c", 1]["t"] == 0 and {r["owner"] for r in found.values()} == {0, 1}


def test_files(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(200))
    texts = {"a.txt": "x\ny\nshared", "b.txt": "shared", "c.txt": base, "d.txt": base.replace("word100 ", ""), "e.txt": "x\ny\nshared"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in texts]
    assert files.exact_line_files(spark, paths, str(tmp_path / "lines")) == 5
    assert {p.name: p.read_text() for p in (tmp_path / "lines").iterdir() if p.suffix == ".txt"} == {"a.txt": "", "b.txt": "", "c.txt": base, "d.txt": texts["d.txt"], "e.txt": ""}
    assert files.minhash_files(spark, paths, str(tmp_path / "near"), 500, 50, 5, 0.8) == 3
    assert {p.name for p in (tmp_path / "near").iterdir() if p.suffix == ".txt"} == {"a.txt", "b.txt", "c.txt"}
    files.write_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_files_of_the_same_name(spark, tmp_path, monkeypatch):
    for folder, text in (("a", "one\nboth"), ("b", "two\nboth")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.txt").write_text(text)
    (tmp_path / "a" / "11.txt").write_text("eleven")
    paths = [str(tmp_path / p) for p in ("a/1.txt", "b/1.txt", "a/11.txt")]
    assert [(r["doc_id"], r["name"], r["text"]) for r in files.read_files(spark, paths).orderBy("doc_id").collect()] == [(0, "0-1.txt", "one\nboth"), (1, "1-1.txt", "two\nboth"), (2, "11.txt", "eleven")]
    assert files.exact_line_files(spark, [f"file://{paths[0]}", *paths[1:]], str(tmp_path / "out")) == 3
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if p.suffix == ".txt"} == {"0-1.txt": "one", "1-1.txt": "two", "11.txt": "eleven"}


def test_rules_and_buckets(spark):
    state = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, 3.0)], "param string, idx long, p double")
    grads = spark.createDataFrame([(r, n, 0, g) for r, g in ((0, 0.5), (1, 1.5)) for n in "ab"], "rank int, param string, idx long, grad double")
    mean = distributed.reduced_buckets(grads, spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "param string, bucket int"))
    assert sorted(tuple(r) for r in mean.collect()) == [(0, "a", 0, 1.0), (1, "b", 0, 1.0)]
    found = distributed.sharded_step(state, mean, 2, rule=distributed.sgd_rule(0.1))
    assert {r["param"]: round(r["p"], 6) for r in found.collect()} == {"a": 0.9, "b": 1.9, "c": 3.0}

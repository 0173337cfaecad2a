"""Queries on numbers: vector functions, attention, schedules, optimiser steps, gradients of several workers.

Embeddings serve as vectors; the weights of layers are made by rule, so that SQL can make them too.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import vectors as v
from millrace.operators import attention, distributed, transformer, windows
from millrace.ordering import places_in_groups
from millrace.scratch import Scratch
from millrace.session import table

OUT = 4


def weight(i: int, j: int, shift: int = 0) -> float:
    """Entry (i, j) of a layer's weights."""
    return ((i * 7 + j * 3 + shift) % 11 - 5) / 10.0


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("x"), F.col("label"))


def _width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("x"))).first()[0] or 0


def _flat(rows: DataFrame, column, digits: int = 4) -> DataFrame:
    """vec_id, i, y: one row for each component, rounded."""
    each = rows.select("vec_id", F.posexplode(column).alias("i", "y"))
    return each.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("y", digits) + 0.0).alias("y"))


def vec_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_vectors(spark, d), v.softmax(F.col("x")), 6)


def vec_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_vectors(spark, d), v.log_softmax(F.col("x")))


def vec_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as logits, its label as target; also the mean."""
    loss = _vectors(spark, d).select("vec_id", v.cross_entropy(F.col("x"), F.col("label")).alias("loss"))
    mean = loss.agg(F.lit(-1).cast("long").alias("vec_id"), F.avg("loss").alias("loss"))
    return loss.unionByName(mean).select("vec_id", F.round("loss", 4).alias("loss"))


def vec_silu(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_vectors(spark, d), v.silu(F.col("x")))


def vec_rmsnorm(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_vectors(spark, d), v.rms_norm(F.col("x")))


def vec_rope(spark: SparkSession, d: str) -> DataFrame:
    """Position: vec_id modulo 128."""
    return _flat(_vectors(spark, d), v.rope(F.col("x"), F.pmod("vec_id", F.lit(128))))


def vec_linear(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    n = _width(rows)
    return _flat(rows, v.linear(F.col("x"), [[weight(i, j) for j in range(n)] for i in range(OUT)]))


def vec_swiglu(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    n = _width(rows)
    layer = lambda out, width, shift: [[weight(i, j, shift) for j in range(width)] for i in range(out)]
    gate = F.zip_with(v.silu(v.linear(F.col("x"), layer(OUT, n, 0))), v.linear(F.col("x"), layer(OUT, n, 1)), lambda a, b: a * b)
    return _flat(rows.select("vec_id", gate.alias("g")), v.linear(F.col("g"), layer(OUT, OUT, 2)))


def _attention(causal: bool, builtin: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = attention.windows(_vectors(spark, d).select(F.col("vec_id").alias("id"), "x"))
        found = (attention.self_attention_builtin if builtin else attention.self_attention)(rows, causal)
        found = found.select((F.col("seq") * attention.WINDOW + F.col("pos")).alias("vec_id"), "out")
        return _flat(found, F.col("out"))

    return query


def attention_lse(spark: SparkSession, d: str) -> DataFrame:
    rows = attention.windows(_vectors(spark, d).select(F.col("vec_id").alias("id"), "x"))
    return attention.self_attention(rows, True).select((F.col("seq") * attention.WINDOW + F.col("pos")).alias("vec_id"), F.round("lse", 4).alias("lse"))


def attention_backward(spark: SparkSession, d: str) -> DataFrame:
    """Gradients of the values under causal attention whose output has the gradient 1 in every component."""
    rows = attention.windows(_vectors(spark, d).select(F.col("vec_id").alias("id"), "x"))
    found = attention.self_attention_backward(rows.withColumn("grad", F.transform("x", lambda e: F.lit(1.0))), True)
    found = found.select((F.col("seq") * attention.WINDOW + F.col("pos")).alias("vec_id"), "dv")
    return _flat(found, F.col("dv"))


def causal_frame(spark: SparkSession, d: str) -> DataFrame:
    """Sum of a user's values up to each event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 2).alias("total"), F.count("*").over(w).alias("n"))


def lr_cosine_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(25).select("id", F.round(v.cosine_schedule(F.col("id"), 1.0, 0.1, 7, 21), 6).alias("rate"))


def adamw_step(spark: SparkSession, d: str) -> DataFrame:
    """Two steps of every component of every vector, whose gradient is half of itself and then a quarter."""
    rows = _vectors(spark, d).select("vec_id", F.posexplode("x").alias("i", "p"))
    zero, p = F.lit(0.0), F.col("p")
    one = rows.withColumn("s", v.adamw(p, p * 0.5, zero, zero, F.lit(1), 0.1))
    two = one.withColumn("s", v.adamw(F.col("s.p"), F.col("p") * 0.25, F.col("s.m"), F.col("s.v"), F.lit(2), 0.1))
    return two.select("vec_id", F.col("i").cast("long").alias("i"), *[(F.round(f"s.{c}", 5) + 0.0).alias(c) for c in ("p", "m", "v")])


def _grads(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as gradients: label is the worker, vec_id modulo 16 the parameter."""
    rows = _vectors(spark, d).select(F.col("label").alias("rank"), F.pmod("vec_id", F.lit(16)).alias("param"), F.posexplode("x").alias("idx", "grad"))
    return rows.withColumn("idx", F.col("idx").cast("long"))


def grad_allreduce_mean(spark: SparkSession, d: str) -> DataFrame:
    found = distributed.mean_gradients(_grads(spark, d))
    return found.select("param", "idx", (F.round("grad", 4) + 0.0).alias("grad"))


def grad_accumulate(spark: SparkSession, d: str) -> DataFrame:
    found = distributed.accumulated(_grads(spark, d))
    return found.select("param", "idx", (F.round("grad", 4) + 0.0).alias("grad"))


def grad_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select("vec_id", F.posexplode("x").alias("i", "grad"))
    return distributed.clipped(rows, 1.0).select("vec_id", F.col("i").cast("long").alias("i"), (F.round("grad", 5) + 0.0).alias("grad"))


def bucket_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each order, last first, in buckets of 60 units."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity")), asc=False).alias("lines"))
    found = lines.select("l_orderkey", F.arrays_zip(F.col("lines.l_linenumber").alias("line"), windows.size_buckets(F.col("lines.l_quantity"), 60.0).alias("bucket")).alias("z"))
    each = found.select("l_orderkey", F.explode("z").alias("z"))
    return each.select("l_orderkey", F.col("z.line").cast("long").alias("line"), F.col("z.bucket").alias("bucket"))


def _placed_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return places_in_groups(Scratch(spark, "places"), parts, "p_brand", [F.col("p_partkey")], "at", "n", "parts")


def round_robin_shard(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each brand dealt to 4 owners in turn."""
    return _placed_parts(spark, d).select("p_partkey", windows.round_robin(F.col("at"), 4).cast("long").alias("owner"))


def contiguous_shard(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each brand in 4 runs."""
    return _placed_parts(spark, d).select("p_partkey", windows.contiguous(F.col("at"), F.col("n"), 4).alias("shard"))


def timing_mean_std(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))


def parameter_count(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as parameters of their length times their label, those of label 0 being embeddings."""
    shape = F.array(F.size("x").cast("long"), F.col("label").cast("long") + 1)
    rows = _vectors(spark, d).select(F.when(F.col("label") == 0, "embed").otherwise("layer").alias("name"), shape.alias("shape"))
    return distributed.parameter_count(rows)


def embedding_gather(spark: SparkSession, d: str) -> DataFrame:
    """The vector of each document, by number, and its squared length."""
    rows = _vectors(spark, d).select("vec_id", "x")
    n = rows.count()
    docs = table(spark, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(n)).alias("vec_id"))
    return docs.join(rows, "vec_id").select("doc_id", F.round(v.dot(F.col("x"), F.col("x")), 4).alias("y"))


def row_dot_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sum of each vector's components times those of its softmax."""
    return _vectors(spark, d).select("vec_id", F.round(v.dot(F.col("x"), v.softmax(F.col("x"))), 4).alias("y"))


def sharded_adamw(spark: SparkSession, d: str) -> DataFrame:
    """One step of parameters by label, whose vectors of even number have a gradient, dealt to 4 owners."""
    rows = _vectors(spark, d).select("vec_id", F.col("label").cast("string").alias("param"), F.posexplode("x").alias("i", "p"))
    rows = rows.withColumn("idx", F.col("vec_id") * 1_000 + F.col("i"))
    state = rows.select("param", "idx", "p", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0).alias("t"))
    grads = rows.where("vec_id % 2 = 0").select("param", "idx", (F.col("p") * 0.5).alias("grad"))
    found = distributed.sharded_step(state, grads, 4, 0.1)
    return found.select("param", "idx", F.col("owner").cast("long").alias("owner"), (F.round("p", 5) + 0.0).alias("p"), F.col("t").cast("long").alias("t"))


LM = transformer.Shape(vocab=50, context=64, width=16, layers=2, heads=4, hidden=32)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as rows of ids below the vocabulary's size; one that is longer than the context is an error."""
    x = F.when(F.size("x") > LM.context, F.raise_error(F.lit(f"more than {LM.context} components"))).otherwise(F.col("x"))
    ids = F.transform(x, lambda e: F.pmod(F.floor(e * 64), F.lit(LM.vocab)).cast("int"))
    return _vectors(spark, d).select("vec_id", ids.alias("ids"))


def lm_losses(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy of each row under a transformer with random weights."""
    n = F.size("ids") - 1
    rows = _ids(spark, d).select("vec_id", F.slice("ids", 1, n).alias("x"), F.slice("ids", 2, n).alias("y"))
    return transformer.losses(rows, transformer.initial(LM), LM).select("vec_id", F.round("loss", 6).alias("loss"))


def lm_generate(spark: SparkSession, d: str) -> DataFrame:
    """Five ids after each row."""
    rows = _ids(spark, d).select(F.col("vec_id").alias("prompt_id"), "ids")
    found = transformer.completions(rows, transformer.initial(LM), LM, 5, temperature=0.8, top_k=20, top_p=0.95)
    return found.select("prompt_id", F.array_join(F.col("new_ids").cast("array<string>"), " ").alias("new_ids"))


def parameters_close(spark: SparkSession, d: str) -> DataFrame:
    """Whether vectors are within tolerances of the mean vector of their label."""
    rows = _vectors(spark, d).select("vec_id", "label", F.posexplode("x").alias("i", "y"))
    mean = rows.groupBy("label", "i").agg(F.avg("y").alias("m"))
    both = rows.join(mean, ["label", "i"])
    return both.groupBy("vec_id").agg(F.bool_and(distributed.close(F.col("y"), F.col("m"), 0.05, 0.3)).alias("close"))


QUERIES = {
    f.__name__: f
    for f in (
        vec_softmax, vec_log_softmax, vec_cross_entropy, vec_silu, vec_rmsnorm, vec_rope, vec_linear, vec_swiglu, attention_lse, attention_backward,
        causal_frame, lr_cosine_schedule, adamw_step, grad_allreduce_mean, grad_accumulate, grad_clip, bucket_assignment,
        round_robin_shard, contiguous_shard, timing_mean_std, parameter_count, parameters_close, embedding_gather, row_dot_sum,
        sharded_adamw, lm_losses, lm_generate,
    )
} | {
    "attention": _attention(False, True),
    "attention_causal": _attention(True, True),
    "attention_online": _attention(False, False),
    "attention_online_causal": _attention(True, False),
}

_X = "WITH x AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS y FROM embeddings)"
_EXP = _X + ", m AS (SELECT vec_id, max(y) AS top FROM x GROUP BY vec_id), l AS (SELECT x.vec_id, any_value(top) + ln(sum(exp(y - top))) AS lse FROM x JOIN m USING (vec_id) GROUP BY x.vec_id)"


def _weight_sql(i: str, j: str, shift: int) -> str:
    return f"((({i} * 7 + {j} * 3 + {shift}) % 11 - 5) / 10.0)"


def _layer_sql(name: str, source: str, shift: int) -> str:
    return f"{name} AS (SELECT vec_id, o, sum(y * {_weight_sql('o', 'i', shift)}) AS y FROM {source}, range({OUT}) t(o) GROUP BY vec_id, o)"


def _attention_sql(causal: bool) -> str:
    n = attention.WINDOW
    return (
        _X
        + f""", s AS (SELECT a.vec_id AS q, b.vec_id AS k, sum(a.y * b.y) / sqrt(count(*)) AS s FROM x a JOIN x b ON a.vec_id // {n} = b.vec_id // {n} AND a.i = b.i
    {'AND b.vec_id <= a.vec_id' if causal else ''} GROUP BY a.vec_id, b.vec_id), t AS (SELECT q, max(s) AS top FROM s GROUP BY q),
l AS (SELECT s.q, any_value(top) + ln(sum(exp(s - top))) AS lse FROM s JOIN t USING (q) GROUP BY s.q)"""
    )


_OUT_SQL = " SELECT s.q AS vec_id, x.i::BIGINT AS i, round(sum(exp(s - lse) * y), 4) + 0.0 AS y FROM s JOIN l USING (q) JOIN x ON x.vec_id = s.k GROUP BY s.q, x.i"
_ADAM = "(p - 0.1 * sqrt(1 - 0.999 ** {t}) / (1 - 0.9 ** {t}) * m / (sqrt(v) + 1e-8)) * (1 - 0.1 * 0.01)"
SQL = {
    "vec_softmax": _EXP + " SELECT vec_id, i::BIGINT AS i, round(exp(y - lse), 6) + 0.0 AS y FROM x JOIN l USING (vec_id)",
    "vec_log_softmax": _EXP + " SELECT vec_id, i::BIGINT AS i, round(y - lse, 4) + 0.0 AS y FROM x JOIN l USING (vec_id)",
    "vec_cross_entropy": _EXP + ", c AS (SELECT vec_id, lse - y AS loss FROM x JOIN l USING (vec_id) WHERE i = label) SELECT vec_id, round(loss, 4) AS loss FROM c UNION ALL SELECT -1, round(avg(loss), 4) FROM c",
    "vec_silu": _X + " SELECT vec_id, i::BIGINT AS i, round(y / (1 + exp(-y)), 4) + 0.0 AS y FROM x",
    "vec_rmsnorm": _X + " SELECT vec_id, i::BIGINT AS i, round(y / sqrt(avg(y * y) OVER (PARTITION BY vec_id) + 1e-5), 4) + 0.0 AS y FROM x",
    "vec_rope": _X
    + """, a AS (SELECT x.*, (vec_id % 128) / 10000.0 ** ((i - i % 2)::DOUBLE / count(*) OVER (PARTITION BY vec_id)) AS t FROM x)
SELECT a.vec_id, a.i::BIGINT AS i, round(a.y * cos(a.t) + CASE WHEN a.i % 2 = 0 THEN -b.y ELSE b.y END * sin(a.t), 4) + 0.0 AS y FROM a JOIN x b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i + 1 ELSE a.i - 1 END""",
    "vec_linear": _X + f", {_layer_sql('w', 'x', 0)} SELECT vec_id, o::BIGINT AS i, round(y, 4) + 0.0 AS y FROM w",
    "vec_swiglu": _X
    + f", {_layer_sql('a', 'x', 0)}, {_layer_sql('b', 'x', 1)}, g AS (SELECT a.vec_id, a.o AS i, a.y / (1 + exp(-a.y)) * b.y AS y FROM a JOIN b ON a.vec_id = b.vec_id AND a.o = b.o), {_layer_sql('w', 'g', 2)} SELECT vec_id, o::BIGINT AS i, round(y, 4) + 0.0 AS y FROM w",
    "attention": _attention_sql(False) + _OUT_SQL,
    "attention_causal": _attention_sql(True) + _OUT_SQL,
    "attention_online": _attention_sql(False) + _OUT_SQL,
    "attention_online_causal": _attention_sql(True) + _OUT_SQL,
    "attention_backward": _attention_sql(True) + ", g AS (SELECT s.k AS vec_id, sum(exp(s - lse)) AS y FROM s JOIN l USING (q) GROUP BY s.k) SELECT vec_id, i::BIGINT AS i, round(g.y, 4) + 0.0 AS y FROM g JOIN x USING (vec_id)",
    "attention_lse": _attention_sql(True) + " SELECT q AS vec_id, round(lse, 4) AS lse FROM l",
    "causal_frame": "SELECT event_id, round(sum(value) OVER w, 2) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "lr_cosine_schedule": f"SELECT range AS id, round(CASE WHEN range < 7 THEN range / 7.0 WHEN range <= 21 THEN 0.1 + (1 + cos((range - 7) / 14.0 * {math.pi})) * 0.45 ELSE 0.1 END, 6)::DOUBLE AS rate FROM range(25)",
    "adamw_step": _X
    + f""", one AS (SELECT vec_id, i, y, y AS p, 0.1 * (y * 0.5) AS m, 0.001 * (y * 0.5) * (y * 0.5) AS v FROM x), moved AS (SELECT vec_id, i, y, {_ADAM.format(t=1)} AS p, m, v FROM one),
two AS (SELECT vec_id, i, p, m * 0.9 + 0.1 * (y * 0.25) AS m, v * 0.999 + 0.001 * (y * 0.25) * (y * 0.25) AS v FROM moved)
SELECT vec_id, i::BIGINT AS i, round({_ADAM.format(t=2)}, 5) + 0.0 AS p, round(m, 5) + 0.0 AS m, round(v, 5) + 0.0 AS v FROM two""",
    "grad_allreduce_mean": _X + " SELECT vec_id % 16 AS param, i::BIGINT AS idx, round(sum(y) / (SELECT count(DISTINCT label) FROM x), 4) + 0.0 AS grad FROM x GROUP BY 1, 2",
    "grad_accumulate": _X + ", o AS (SELECT label, vec_id % 16 AS param, i, avg(y) AS y FROM x GROUP BY 1, 2, 3) SELECT param, i::BIGINT AS idx, round(sum(y) / (SELECT count(DISTINCT label) FROM x), 4) + 0.0 AS grad FROM o GROUP BY 1, 2",
    "grad_clip": _X + " SELECT vec_id, i::BIGINT AS i, round(y * least(1.0, 1.0 / ((SELECT sqrt(sum(y * y)) FROM x) + 1e-6)), 5) + 0.0 AS grad FROM x",
    "bucket_assignment": """WITH RECURSIVE n AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS k FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, k, 0::BIGINT AS bucket, l_quantity AS used FROM n WHERE k = 1
    UNION ALL SELECT n.l_orderkey, n.l_linenumber, n.k, CASE WHEN (b.used > 0 AND b.used + n.l_quantity > 60) OR b.used >= 60 THEN b.bucket + 1 ELSE b.bucket END,
    CASE WHEN (b.used > 0 AND b.used + n.l_quantity > 60) OR b.used >= 60 THEN n.l_quantity ELSE b.used + n.l_quantity END FROM b JOIN n ON n.l_orderkey = b.l_orderkey AND n.k = b.k + 1)
SELECT l_orderkey, l_linenumber::BIGINT AS line, bucket FROM b""",
    "round_robin_shard": "SELECT p_partkey, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 4)::BIGINT AS owner FROM part",
    "contiguous_shard": "SELECT p_partkey, least((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // greatest(count(*) OVER (PARTITION BY p_brand) // 4, 1), 3)::BIGINT AS shard FROM part",
    "timing_mean_std": "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events GROUP BY event_type",
    "parameter_count": "SELECT sum(len(embedding) * (label + 1))::BIGINT AS n, sum(CASE WHEN label = 0 THEN 0 ELSE len(embedding) * (label + 1) END)::BIGINT AS n_without_embeddings FROM embeddings",
    "embedding_gather": "SELECT doc_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS y FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)",
    "row_dot_sum": _EXP + " SELECT vec_id, round(sum(y * exp(y - lse)), 4) AS y FROM x JOIN l USING (vec_id) GROUP BY vec_id",
    "sharded_adamw": _X
    + f""", s AS (SELECT vec_id, label::VARCHAR AS param, vec_id * 1000 + i AS idx, y AS p, 0.1 * (y * 0.5) AS m, 0.001 * (y * 0.5) * (y * 0.5) AS v FROM x),
o AS (SELECT param, (row_number() OVER (ORDER BY param) - 1) % 4 AS owner FROM (SELECT DISTINCT param FROM s))
SELECT param, idx::BIGINT AS idx, owner::BIGINT AS owner, round(CASE WHEN vec_id % 2 = 0 THEN {_ADAM.format(t=1)} ELSE p END, 5) + 0.0 AS p, (CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS t FROM s JOIN o USING (param)""",
    "parameters_close": _X + ", m AS (SELECT label, i, avg(y) AS m FROM x GROUP BY label, i) SELECT vec_id, bool_and(abs(y - m) <= 0.3 + 0.05 * abs(m)) AS close FROM x JOIN m USING (label, i) GROUP BY vec_id",
}

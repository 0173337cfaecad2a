"""What data-parallel training does between its workers, as aggregations: averaged gradients, norms, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.vectors import adamw


def mean_gradients(grads: DataFrame) -> DataFrame:
    """param, idx, grad: mean over workers (rank, param, idx, grad); a worker without a value counts as 0."""
    workers = grads.agg(F.count_distinct("rank").alias("workers"))
    summed = grads.groupBy("param", "idx").agg(F.sum("grad").alias("s"))
    return summed.join(F.broadcast(workers)).select("param", "idx", (F.col("s") / F.col("workers")).alias("grad"))


def accumulated(grads: DataFrame) -> DataFrame:
    """Mean over workers of each worker's mean over its micro-steps (rank, step, param, idx, grad)."""
    own = grads.groupBy("rank", "param", "idx").agg(F.avg("grad").alias("grad"))
    return mean_gradients(own)


def clipped(grads: DataFrame, limit: float, eps: float = 1e-6) -> DataFrame:
    """grads (.., grad) scaled so that their norm over all rows is at most the limit."""
    norm = grads.agg(F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("_norm"))
    scale = F.least(F.lit(1.0), F.lit(limit) / (F.col("_norm") + eps))
    return grads.join(F.broadcast(norm)).withColumn("grad", F.col("grad") * scale).drop("_norm")


def parameter_count(shapes: DataFrame) -> DataFrame:
    """n, n_without_embeddings of shapes (name, shape array<bigint>)."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b)
    return shapes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("name").contains("embed"), size)), F.lit(0)).alias("n_without_embeddings"))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether two values are equal up to tolerances."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def with_gradient(params: DataFrame, grads: DataFrame) -> DataFrame:
    """params (param, idx, ..) that have a gradient, with it."""
    return params.join(grads.select("param", "idx", "grad"), ["param", "idx"])


def adamw_rule(lr: float, **how: float):
    """AdamW as a rule for sharded_step(): state columns p, m, v, t."""
    return lambda grad: adamw(F.col("p"), grad, F.col("m"), F.col("v"), F.col("t") + 1, lr, **how)


def sgd_rule(lr: float):
    """Plain gradient descent as a rule for sharded_step(): state column p."""
    return lambda grad: F.struct((F.col("p") - F.lit(lr) * grad).alias("p"))


def reduced_buckets(grads: DataFrame, buckets: DataFrame) -> DataFrame:
    """bucket, param, idx, grad: means over workers (rank, param, idx, grad), bucket by bucket (param, bucket), laid out so
    that each task holds parts of one bucket. Parameters of no bucket are left out."""
    placed = grads.join(F.broadcast(buckets), "param")  # one row for each parameter
    workers = grads.agg(F.count_distinct("rank").alias("workers"))
    summed = placed.groupBy("bucket", "param", "idx").agg(F.sum("grad").alias("s"))
    return summed.join(F.broadcast(workers)).select("bucket", "param", "idx", (F.col("s") / F.col("workers")).alias("grad"))


def sharded_step(state: DataFrame, grads: DataFrame, owners: int, lr: float | None = None, rule=None, **how: float) -> DataFrame:
    """state (param, idx, p and what the rule keeps) after one step, with the owner of each parameter.

    rule: from the gradient's column to a struct of the new state; AdamW (p, m, v, t) with the rate lr by default.
    Parameters in order of name are dealt to owners in turn. Rows are laid out by owner and place, so an owner's state
    is spread over as many tasks as it needs. A parameter without a gradient stays as it is.
    """
    rule = rule or adamw_rule(lr, **how)
    kept_columns = [c for c in state.columns if c not in ("param", "idx")]
    names = state.select("param").distinct()
    order = W.orderBy("param")  # one row for each parameter
    owned = names.select("param", F.pmod(F.row_number().over(order) - 1, F.lit(owners)).alias("owner"))
    rows = state.join(owned, "param").join(grads.select("param", "idx", "grad"), ["param", "idx"], "left").repartition("owner", "param", "idx")
    step = rule(F.col("grad"))
    kept = F.struct(*[F.col(c).alias(c) for c in kept_columns])
    return rows.select("param", "idx", "owner", F.when(F.col("grad").isNull(), kept).otherwise(step).alias("s")).select("param", "idx", "owner", "s.*")

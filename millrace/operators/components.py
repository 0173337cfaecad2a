"""Connected components of a graph that is spread over the executors."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import Scratch

#: Most rows of a table that is broadcast.
MAX_BROADCAST_ROWS = 100_000


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes (node, rank), edges (a, b) in either direction; returns node, least, top: the least rank that a node reaches,
    and the node that has it. All nodes of a component have one top, and no other component has it, whatever the ranks.

    Every node starts with the label (own rank, own name) and takes the least label among its neighbours'; then it
    takes the label of the node that its label names, which doubles the reach of each round. Each round is written
    out, and rounds go on until no label changes: labels only fall, so that comes. A null rank counts as greater than
    any number. Nodes without edges keep their own rank.
    """
    scratch.table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    edges = scratch.spark.read.parquet(scratch.path("edges"))
    alone = nodes.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", F.col("rank").alias("least"), F.col("node").alias("top"))
    linked = nodes.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    labels = scratch.table(linked.select("node", F.struct(F.col("rank").isNull().alias("unranked"), "rank", F.col("node").alias("at")).alias("label")), "labels0")
    for turn in count(1):
        told = edges.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("told"))
        near = labels.join(told, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "told").alias("label"))
        near = scratch.table(near, f"near{turn}")
        # labels are named by many nodes, so only those that moved on are looked up: one row for each label
        moved = near.where("label.at <> node").select(F.col("node").alias("at"), F.col("label").alias("onward"))
        used = near.groupBy(F.col("label.at").alias("at")).agg(F.lit(1).alias("one")).select("at")
        moved = moved.join(used, "at", "left_semi")
        if moved.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
            moved = F.broadcast(moved)
        jumped = near.join(moved, near["label.at"] == moved["at"], "left").select("node", "old", F.coalesce("onward", "label").alias("label"))
        jumped = scratch.table(jumped, f"labels{turn}")
        changed = jumped.where("old <> label").limit(1).count()
        scratch.drop(f"near{turn}", f"labels{turn - 1}")
        labels = jumped.select("node", "label")
        if not changed:
            break
    return alone.unionByName(labels.select("node", F.col("label.rank").alias("least"), F.col("label.at").alias("top")))

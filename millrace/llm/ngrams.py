"""Katz backoff of any order in partitioned tables, for scoring texts that come later.

P(w | h) for a history h of up to order - 1 words is d(c) c(h w) / c(h) where h w was seen in training, else
alpha(h) P(w | h without its first word); katz.py has the discounts d and what is done where they leave nothing. alpha
makes every distribution sum to 1 exactly. Histories reach back to the start of a text and no further.

A model is a folder of two tables, each partitioned by order: `grams` (history, word, n, p) and `histories` (history,
alpha). Words are kept as they are, so no two can collide. A history that very many words follow, or a word in very many
texts, is a hot key of the joins here: those are broadcast (common.py: lookup), all else is shuffled.

katz.py computes the same scores for order two from packed chunks, with a fraction of the shuffle; this is for higher
orders and for models that are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup
from .katz import K, discounts

WORD = r"[^\x20\x09-\x0D]+"
GRAMS = "history array<string>, word string, n long, p double, order int"
HISTORIES = "history array<string>, alpha double, total long, longest int, order int"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def events(docs: DataFrame, order: int) -> DataFrame:
    """All columns of docs but text, history (up to order - 1 words; the empty word is the start), word (empty: the end)."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    mark = F.array(F.lit(""))
    padded = docs.withColumn("text", F.concat(mark, words, mark))
    at = F.sequence(F.lit(1), F.size("text") - 1)
    first = lambda j: F.greatest(j - (order - 1), F.lit(0))
    each = F.transform(at, lambda j: F.struct(F.slice("text", first(j) + 1, j - first(j)).alias("history"), F.get("text", j).alias("word")))
    return padded.withColumn("_event", F.explode(each)).select(*[c for c in docs.columns if c != "text"], "_event.history", "_event.word")


def _last(history: str | Column, n: int) -> Column:
    return F.slice(history, F.size(history) - (n - 1), n) if n else F.slice(history, 1, 0)


def _table_of(discount: np.ndarray) -> Column:
    """What is kept of a count n."""
    d = F.array(*[F.lit(float(x)) for x in discount])
    return F.element_at(d, F.least(F.col("n"), F.lit(K + 1)).cast("int") + 1) * F.col("n")


def train(docs: DataFrame, order: int, path: str) -> "Model":
    """Learn from docs (text) and write the model to path. Null and empty texts are their end alone; without any text
    the model gives every word probability 1."""
    if order < 1:
        raise ValueError("the order must be 1 or more")
    scratch = Scratch(docs.sparkSession, "ngrams")
    longest = scratch.table(events(docs.select("text"), order).groupBy("history", "word").agg(F.count("*").alias("n")), "longest")
    lower = unknown = None
    for k in range(1, order + 1):
        grams = longest.where(F.size("history") >= k - 1).groupBy(_last("history", k - 1).alias("history"), "word").agg(F.sum("n").alias("n"))
        grams = scratch.table(grams, f"counts{k}")
        few = {r["n"]: r["c"] for r in grams.where(F.col("n") <= K + 1).groupBy("n").agg(F.count("*").alias("c")).collect()}  # K + 1 rows
        d = discounts(np.array([0, *[few.get(n, 0) for n in range(1, K + 2)]]))
        kept = _table_of(d)
        if k == 1:
            total, rest = grams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(kept), F.lit(0.0))).first()
            over = total if total - rest > 1e-9 * max(1, total) else total + 1
            unknown = (over - rest) / over
            found = grams.select("history", "word", "n", (kept / float(over)).alias("p"))
            histories = docs.sparkSession.createDataFrame([([], float(unknown), total, order)], "history array<string>, alpha double, total long, longest int")
        else:
            stats = grams.groupBy("history").agg(F.count("*").alias("rows"), (F.sum("n") + F.when(F.min("n") > K, 1).otherwise(0)).alias("over"))
            found = lookup(grams, scratch.table(stats, f"stats{k}"), ["history"], "rows").withColumn("p", kept / F.col("over"))
            shorter = found.withColumn("shorter", _last("history", k - 2))
            below = lower.select(F.col("history").alias("shorter"), F.col("word").alias("same"), F.col("p").alias("below"))
            both = shorter.join(below, (shorter["shorter"] == below["shorter"]) & (shorter["word"] == below["same"]))
            left = both.groupBy("history").agg(((1 - F.sum("p")) / F.greatest(1 - F.sum("below"), F.lit(float(unknown)))).alias("alpha"))
            histories = left.withColumns({"total": F.lit(None).cast("long"), "longest": F.lit(None).cast("int")})
            found = found.select("history", "word", "n", "p")
        found.withColumn("order", F.lit(k)).write.mode("overwrite" if k == 1 else "append").partitionBy("order").parquet(f"{path}/grams")
        histories.withColumn("order", F.lit(k)).write.mode("overwrite" if k == 1 else "append").partitionBy("order").parquet(f"{path}/histories")
        lower = docs.sparkSession.read.schema(GRAMS).parquet(f"{path}/grams").where(F.col("order") == k).drop("order")
    return Model(docs.sparkSession, path)


class Model:
    """A model that train() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.grams, self.histories = spark.read.schema(GRAMS).parquet(f"{path}/grams"), spark.read.schema(HISTORIES).parquet(f"{path}/histories")
        base = self.histories.where("order = 1").first()
        self.order, self.unknown, self.train_tokens = base["longest"], base["alpha"], base["total"]

    def log_probabilities(self, asked: DataFrame) -> DataFrame:
        """asked (history, word, each pair once) with log_p (to base 10) and known (whether the word was seen)."""
        rows = asked.withColumn("_rows", F.lit(1))
        for k in range(self.order, 0, -1):
            own = F.when(F.size("history") >= k - 1, _last("history", k - 1))
            rows = rows.withColumn("_h", own)
            of_order = self.grams.where(F.col("order") == k).select(F.col("history").alias("_h"), F.col("word").alias("_w"), F.col("p").alias(f"_p{k}"))
            rows = rows.join(of_order, (rows["_h"] == of_order["_h"]) & (rows["word"] == of_order["_w"]), "left").drop(of_order["_h"]).drop("_w")
            if k > 1:
                counts = rows.where("_h is not null").groupBy("_h").agg(F.count("*").alias("n"))
                alpha = self.histories.where(F.col("order") == k).select(F.col("history").alias("_h"), F.col("alpha").alias(f"_a{k}"))
                rows = lookup(rows, counts.join(alpha, "_h"), ["_h"], "n")
        p1 = F.coalesce("_p1", F.lit(float(self.unknown)))
        back = lambda lower, k: F.coalesce(F.log10(f"_p{k}"), F.log10(F.coalesce(f"_a{k}", F.lit(1.0))) + lower)
        log_p = reduce(back, range(2, self.order + 1), F.log10(p1))
        return rows.select(*asked.columns, log_p.alias("log_p"), F.col("_p1").isNotNull().alias("known"))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, score (log10 probability of the text with its end) of every row of docs (doc_id, text)."""
        scratch = Scratch(docs.sparkSession, "score")
        rows = scratch.table(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
        # a pair counts once for each text
        each = scratch.table(events(rows.select("row", "text"), self.order).groupBy("row", "history", "word").agg(F.count("*").alias("times")), "events")
        asked = scratch.table(each.groupBy("history", "word").agg(F.count("*").alias("rows")), "asked")
        told = scratch.table(self.log_probabilities(asked.select("history", "word")).join(asked, ["history", "word"]), "told")
        found = lookup(each, told, ["history", "word"], "rows")
        known = F.sum(F.when(F.col("known"), F.col("times")).otherwise(0))
        sums = found.groupBy("row").agg(F.sum("times").alias("n_tokens"), known.alias("n_known"), F.sum(F.col("times") * F.col("log_p")).alias("score"))
        return rows.select("row", "doc_id").join(sums, "row").drop("row")

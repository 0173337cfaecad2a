"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets a whole number of copies whose expectation is its source's target over its source's size.
The whole part of that number is taken outright. The fraction is rounded dependently: units of a source meet, words
move from one to the other at random until a fraction becomes 0 or 1, and who is still open goes on to meet the next.
So the expected words of every document and the sum of a source's expected words stay as they are at every meeting.

Meetings happen in blocks. In a block of documents, each meets the smaller ones of its block together, the largest
first: they can take or give what it needs, so it is the large that close, and one of the smallest that stays open.
That one goes up to a block of the next level, where units meet two by two, until one is left in a source. It is
rounded to the nearer side, so that a source misses its target by half of one small document's words or so.

Only DataFrame operations are used. Text is read once, for the word counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.ordering import free_names, sums_before

from .common import Scratch, attach, columns_of, global_rank, lookup, uniform

#: Words are runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
CAP = 2.0
#: Documents that meet in one block of the first level, units in one of the levels above.
DOCUMENTS, BLOCK = 512, 48
#: Rows that are alike in id, source and size and are numbered in one task.
MANY = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null and for texts without words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP
) -> DataFrame:
    """From one row per source (source, source_size, rows) the words that each source shall give.

    Sources ordered by code point, null last, take the weights in turn. A source's target is min(cap * size,
    level * weight), where the level makes the targets add up to min(total, cap) * all sizes: what a source that
    is full can't take goes to the others by weight. Sources may be many: they are ordered by range shuffles.
    """
    placed = global_rank(scratch, sizes, [F.col("source").asc_nulls_last()], "by_name", into="_turn")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_turn", F.lit(len(weights))) + 1).cast("int"))
    named = placed.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(cap))).drop("_turn")
    sums = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    budget = sums["size"] * float(min(total, cap))
    full_at = F.col("full") / F.col("weight")
    order = [full_at, F.col("source").asc_nulls_last()]
    named = sums_before(scratch, named, order, {"full_before": F.col("full"), "weight_before": F.col("weight")}, "by_level")
    # the level if all sources before this one (in order of filling up) are full and no other is
    level = (F.lit(budget) - F.col("full_before")) / (F.lit(float(sums["weight"])) - F.col("weight_before"))
    named = scratch.table(named.withColumn("level", level), "levels")
    # from the first source that isn't full on, these numbers fall, so the greatest that holds is the level
    level = named.where(F.col("level") <= full_at).agg(F.max("level")).first()[0]
    target = F.col("full") if level is None else F.least(F.col("full"), F.lit(float(level)) * F.col("weight"))
    return named.select("source", "source_size", "rows", target.alias("target"))


def _first_meetings(block: Column, seed: int) -> Column:
    """Fold a block of units (size, number, ..., p), the largest first and all of one p, to (open unit, closed units).

    Each unit meets the smaller ones as one: what they gain or lose is dealt out by their room or by their words. They
    have one p at all times, p = a * (the p of the start) + b, so a meeting changes two numbers. Where the smaller ones
    are exhausted before the unit closes, they all close and the unit stays open.
    """
    p0 = F.element_at(block, 1)["p"]

    def step(state: Column, x: Column) -> Column:
        size, p, rest = x["size"], state["p"], state["rest"] - x["size"]
        room, words = size * (1 - p), size * p
        others, others_room = rest * p, rest * (1 - p)
        up, down = F.least(room, others), F.least(words, others_room)
        gains = uniform(F.lit(seed), x["unit"], x["n"], F.lit(1)) * (up + down) < down
        closes = F.when(gains, room <= others).otherwise(words <= others_room)
        last = rest <= 0
        # where the unit closes: p of the others afterwards; where it doesn't: its own, which is then the open one
        after = F.when(gains, F.greatest(F.lit(0.0), p - up / F.nullif(rest, F.lit(0.0)))).otherwise(F.least(F.lit(1.0), p + down / F.nullif(rest, F.lit(0.0))))
        own = F.when(last, p).when(gains, p + up / size).otherwise(p - down / size)
        whole = F.when(gains, F.lit(1.0)).otherwise(F.lit(0.0))
        done = state["open"].isNotNull()
        stays = ~done & (last | ~closes)
        closed = x.withField("p", F.when(done, state["p"]).otherwise(whole))
        return F.struct(
            F.when(done, state["p"]).when(stays, F.when(gains, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(after).alias("p"),
            rest.alias("rest"),
            F.when(stays, x.withField("p", own)).otherwise(state["open"]).alias("open"),
            F.when(stays, state["closed"]).otherwise(F.concat(state["closed"], F.array(closed))).alias("closed"),
        )

    none = F.slice(block, 1, 0)
    total = F.aggregate(block, F.lit(0.0), lambda s, x: s + x["size"])
    start = F.struct(p0.alias("p"), total.alias("rest"), F.get(none, F.lit(0)).alias("open"), none.alias("closed"))
    return F.aggregate(block, start, step, lambda s: F.struct(s["open"].alias("open"), s["closed"].alias("closed")))


def _meet(block: Column, level: int, seed: int) -> Column:
    """Fold a block of units (size, number, ..., p) two by two to (open unit, closed units with p 0 or 1)."""

    def step(state: Column, x: Column) -> Column:
        a, b = state["open"], x
        up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # words that a can gain from b
        down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
        gains = uniform(F.lit(seed), F.lit(level), a["unit"], a["n"], b["unit"], b["n"]) * (up + down) < down
        # which of the two limits binds decides who closes, so that 0 and 1 come out exactly
        a_full = a["size"] * (1 - a["p"]) <= b["size"] * b["p"]
        a_empty = a["size"] * a["p"] <= b["size"] * (1 - b["p"])
        clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        pa = F.when(gains, F.when(a_full, F.lit(1.0)).otherwise(clip(a["p"] + up / a["size"]))).otherwise(
            F.when(a_empty, F.lit(0.0)).otherwise(clip(a["p"] - down / a["size"]))
        )
        pb = F.when(gains, F.when(a_full, clip(b["p"] - up / b["size"])).otherwise(F.lit(0.0))).otherwise(
            F.when(a_empty, clip(b["p"] + down / b["size"])).otherwise(F.lit(1.0))
        )
        a_closed = (gains & a_full) | (~gains & a_empty)
        first, second = a.withField("p", pa), b.withField("p", pb)
        return F.struct(
            F.when(a_closed, second).otherwise(first).alias("open"),
            F.concat(state["closed"], F.array(F.when(a_closed, first).otherwise(second))).alias("closed"),
        )

    start = F.struct(F.element_at(block, 1).alias("open"), F.slice(block, 1, 0).alias("closed"))
    return F.aggregate(F.slice(block, 2, F.greatest(F.size(block), F.lit(1))), start, step)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total: float = TOTAL,
    cap: float = CAP,
    size: Column | None = None,
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes each row of docs (doc_id, text, source).

    Returns doc_id, source, size, source_size, target, copies, taken, one row for each row of docs. size: what
    counts as a document's size, its words by default. Documents of size 0 add nothing; they get one copy if their
    source's mean number of copies is 1 or more, else none (so does a source whose documents are all empty).
    Null ids and null sources are values like others; repeated rows are taken each by its own number. An empty
    table gives an empty result. The result depends on the rows and the seed, not on how they are partitioned.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = word_count(F.col("text")) if size is None else size
    slim = docs.select("doc_id", "source", size.alias("size"))
    # rows that are alike are numbered, or all of them would meet in one block
    alike = scratch.table(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "sizes")
    sources = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("rows"))
    sources = scratch.table(source_targets(scratch.table(sources, "by_source"), scratch, weights, total, cap), "sources")
    most = sources.agg(F.max("rows")).first()[0] or 0

    few = alike.where(F.col("times") <= MANY).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    runs = alike.where(F.col("times") > MANY).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / MANY))))
    runs = runs.repartition("doc_id", "source", "size", "run")
    many = runs.withColumn("n", F.explode(F.sequence(F.col("run") * MANY + 1, F.least((F.col("run") + 1) * MANY, F.col("times"))))).drop("run")
    slim = few.unionByName(many).drop("times")

    mean = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    rows = attach(slim, sources, "source", F.xxhash64("doc_id", "n")).withColumn("mean", mean)
    spread = F.xxhash64(F.lit(seed), "doc_id", "size", "n")
    units = rows.select(
        "source",
        F.pmod(spread, F.greatest(F.lit(1), F.ceil(F.col("rows") / DOCUMENTS))).alias("block"),
        F.ceil(F.col("rows") / DOCUMENTS).alias("blocks"),
        F.struct(
            F.col("size").cast("double").alias("size"),
            F.xxhash64("doc_id", "size").alias("unit"),
            "n",
            "doc_id",
            F.floor("mean").alias("whole"),
            (F.col("mean") - F.floor("mean")).alias("p"),
        ).alias("u"),
    )
    sized = units.where("u.size > 0")
    closed = units.where("u.size = 0").select("source", F.col("u").withField("p", F.lit(0.0)).alias("u"))
    closed = closed.withColumn("u", F.col("u").withField("whole", F.least(F.col("u.whole"), F.lit(1))))
    levels = 1 + max(1, math.ceil(math.log(max(2, most / DOCUMENTS), BLOCK) + 0.5))
    for level in range(levels):
        last = level == levels - 1
        block = F.sort_array(F.collect_list("u"), asc=False)  # the largest first
        met = (
            sized.groupBy("source", "blocks", F.lit(0).alias("block") if last and level else "block")
            .agg(block.alias("u"))
            .select("source", "blocks", "block", (_meet(F.col("u"), level, seed) if level else _first_meetings(F.col("u"), seed)).alias("met"))
        )
        met = scratch.table(met, f"level{level}")
        closed = closed.unionByName(met.select("source", F.explode("met.closed").alias("u")))
        up = F.greatest(F.lit(1), F.ceil(F.col("blocks") / BLOCK))
        sized = met.select("source", up.alias("blocks"), F.pmod("block", up).alias("block"), F.col("met.open").alias("u"))
    final = sized.select("source", F.col("u").withField("p", F.round("u.p")).alias("u"))
    done = closed.unionByName(final).select("source", "u.*")
    done = attach(done, sources.drop("rows"), "source", F.xxhash64("doc_id", "n"))
    copies = (F.col("whole") + F.round("p")).cast("int")
    size = F.col("size").cast("long")
    return done.select(
        "doc_id", "source", size.alias("size"), "source_size", F.col("target").cast("double").alias("target"),
        copies.alias("copies"), (copies * size).alias("taken"),
    )


def take(docs: DataFrame, size: Column | None = None, **options) -> DataFrame:
    """docs with each row as often as mix() takes it (columns of docs only, whatever their names).

    Rows that are alike in id, source and size share what mix() gives them: of such rows, those that get one copy more
    are the first in order of a hash of the text; equal ones among them are interchangeable.
    """
    size = word_count(docs["text"]) if size is None else size
    scratch = Scratch(docs.sparkSession, "take")
    plan = mix(docs, size=size, **options)
    each = plan.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("all"), F.min("copies").alias("low"))
    size_, n, all_, low, rows, copies, more, nth, first, tie = free_names(10, docs)
    each = each.withColumn("rows", F.col("n")).withColumnsRenamed({"size": size_, "n": n, "all": all_, "low": low, "rows": rows})
    each = scratch.table(each.withColumn(more, F.col(all_) - F.col(low) * F.col(n)), "copies")  # so many rows get one copy more
    key = ["doc_id", "source", size_]
    sized = docs.withColumn(size_, size)
    split = (F.col(more) > 0) & (F.col(more) < F.col(n))
    # by a shuffle at every size, or small inputs would say nothing of large ones
    alike = lookup(sized, each.where(~split).hint("merge"), key, rows, "inner")
    out = alike.select(*columns_of(docs), (F.col(low) + F.when(F.col(more) > 0, 1).otherwise(0)).alias(copies))
    if each.where(split).limit(1).count():
        mixed = scratch.table(lookup(sized, each.where(split), key, rows, "inner").withColumn(tie, F.monotonically_increasing_id()), "mixed")
        order = [*[F.col(c).asc_nulls_first() for c in key], F.xxhash64("text").asc(), F.col(tie).asc()]
        ranked = scratch.table(global_rank(scratch, mixed, order, "ordered", into=nth), "ranked")
        placed = lookup(ranked, scratch.table(ranked.groupBy(*key).agg(F.min(nth).alias(first), F.count("*").alias(rows)), "firsts"), key, rows)
        extra = F.when(F.col(nth) - F.col(first) < F.col(more), 1).otherwise(0)
        out = out.unionByName(placed.select(*columns_of(docs), (F.col(low) + extra).alias(copies)))
    return out.withColumn(more, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*columns_of(docs))

"""Near-duplicates by SimHash, found by meeting in the middle.

Two fingerprints at two or fewer differing bits share a variant that differs from each in one bit at most. So every
distinct fingerprint emits itself and its 64 neighbours at one bit, and rows are shuffled on those variants. At most
65 fingerprints can meet at a variant, however many documents there are, and any two that meet are at two bits or
fewer: linking each to the least of them keeps what they connect without listing pairs. Every edge is verified.

That is near_duplicates(), for fingerprints of 64 bits and a given distance. Texts of a similarity of 0.8 differ in
ten bits of 64 or so, whose ball no one can list. one_of_each() therefore takes several short fingerprints of a text
(BLOCKS of BITS bits, over its distinct five-word shingles), each of which emits its ball and finds candidates for
itself, and verifies candidates by the similarity of their shingles. So that short fingerprints don't meet by chance in a
large corpus, each has the least hash of the text's shingles beside it, which texts of that similarity have in common
with that chance; both are one number, whose low bits vary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components
from millrace.ordering import free_names
from millrace.session import small_batches

from .common import HOT_ROWS, MAX_BROADCAST_ROWS, MAX_HOT_KEYS, Scratch, columns_of, lookup, values

SHINGLE = 3
SEED = 42
#: Half of the distance at which fingerprints link; the bits that a variant may differ in.
HALF = 1
#: Shingles whose bits are counted at once.
PIECE = 1 << 15

_hash = xxhash.xxh64_intdigest


def fingerprint(text: str | None) -> int:
    """SimHash of a text as a signed 64-bit number; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([_hash(b" ".join(words), SEED)], np.uint64)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        hashes = np.fromiter(map(_hash, shingles, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text, null for null) and print of every row of docs (doc_id, text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t) for t in values(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), prints], ["doc_id", "content", "print"])

    content = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("content")
    return docs.select("doc_id", "text", content).mapInArrow(go, "doc_id long, content long, print long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct prints at up to 2 * HALF differing bits, each a pair of those."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print")
    variants = prints.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_list("print").alias("met")).where(F.size("met") > 1)
    pairs = met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * HALF)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, content, print, component_id, component of every row of docs (doc_id, text).

    component_id is the least id that links reach; documents without words share print 0 and link like others.
    Rows that repeat are rows of their own in the same component. Null ids are never a component's id, unless no
    other id is in it (then it is null). component is a fingerprint of the component: unlike component_id it is never
    null and tells components apart whose ids are null or the same. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs), "prints")
    distinct = rows.groupBy("print").agg(F.min("doc_id").alias("rank"), F.count("*").alias("rows"))
    distinct = scratch.table(distinct, "distinct")
    edges = scratch.table(links(distinct.select("print")), "links")
    of = components(distinct.select(F.col("print").alias("node"), "rank"), edges, scratch)
    of = scratch.table(of.withColumnRenamed("node", "print").join(distinct.select("print", "rows"), "print"), "components")
    return lookup(rows, of.withColumnsRenamed({"least": "component_id", "top": "component"}), ["print"], "rows")


@dataclass(frozen=True)
class Near:
    """What counts as near: words in a shingle, least share of common shingles; and how it is searched: fingerprints of
    a text, bits of each that may vary."""

    shingle: int = 5
    similarity: float = 0.8
    blocks: int = 8
    bits: int = 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, upper and lower case of A-Z alike; a text of fewer words is one
    shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([_hash(b" ".join(words), SEED)], np.uint64)
    each = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(_hash, each, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def short_prints(hashes: np.ndarray, near: Near) -> list[int]:
    """A text's fingerprints, as signed 64-bit numbers. Each block mixes the hashes anew; the low bits are 1 where more than
    half of the mixed hashes have a 1, the others come from the least of them."""
    out, bytes_ = [], -(-near.bits // 8)
    for k in range(near.blocks):
        ones, least = np.zeros(8 * bytes_, np.int64), (1 << 64) - 1
        for at in range(0, len(hashes), PIECE):
            h = (hashes[at : at + PIECE] ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            least = min(least, int(h.min()))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, :bytes_], axis=1)
            ones += bits.sum(axis=0, dtype=np.int32)
        low = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") & ((1 << near.bits) - 1)
        high = _hash(least.to_bytes(8, "little"), SEED + k) >> near.bits << near.bits
        out.append(((high | low) ^ (1 << 63)) - (1 << 63))
    return out


def _marked(docs: DataFrame, one: str, two: str, mark: str) -> DataFrame:
    """docs with two hashes of the text (null counts as empty) and one of all columns that can be hashed."""
    text = F.coalesce(docs["text"], F.lit(""))
    every = [F.col("`" + c.replace("`", "``") + "`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    return docs.withColumns({one: F.xxhash64(F.lit(1), text), two: F.xxhash64(F.lit(2), text), mark: F.xxhash64(*every)})


def _first(rows: DataFrame, scratch: Scratch, name: str, ways: int = 1) -> DataFrame:
    """print, a, b: nodes b of rows (node, print) with up to `ways` nodes a of the same fingerprint, the first ones in an order
    that differs from fingerprint to fingerprint. The table name_firsts has print, a of all fingerprints."""
    first = F.min_by("node", F.xxhash64("node", "print"))
    part = F.pmod(F.xxhash64(F.lit(ways), "print", "node"), F.lit(ways)).alias("part")
    firsts = rows.groupBy("print", part).agg(first.alias("a"), F.count("*").alias("rows"))
    firsts = firsts.groupBy("print").agg(F.collect_list("a").alias("firsts"), F.sum("rows").alias("rows"))
    firsts = scratch.table(firsts, f"{name}_firsts")
    # most rows are alone with their fingerprint: hot ones, at most MAX_HOT_KEYS, are told by their values, so that no join hands on all rows
    many = firsts.where("rows > 1")
    limit = max(HOT_ROWS, (many.agg(F.sum("rows")).first()[0] or 0) // MAX_HOT_KEYS)
    hot = [r["print"] for r in many.where(F.col("rows") > limit).select("print").collect()]
    many, is_hot = many.select("print", "firsts"), F.col("print").isin(hot)
    met = rows.where(~is_hot).join(many.where(~is_hot), "print")
    if hot:
        met = met.unionByName(rows.where(is_hot).join(F.broadcast(many.where(is_hot)), "print"))
    return scratch.table(met.select("print", F.explode("firsts").alias("a"), F.col("node").alias("b")).where("a <> b"), f"{name}_shared")


def _ordered() -> tuple[Column, Column]:
    """A pair, the lesser node first."""
    return F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")


def _variants(firsts: DataFrame, near: Near) -> DataFrame:
    """print, a, variant: the fingerprints within HALF bits of each of firsts (print, a)."""
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *[1 << b for b in range(near.bits)])])
    spread = firsts.repartition(int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print")
    return spread.select("print", "a", F.explode(flips).alias("flip")).select("print", "a", F.col("print").bitwiseXOR(F.col("flip")).alias("variant"))


def _members(firsts: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """a, at, size, sketch: the first nodes of fingerprints within 2 * HALF bits of others, with the variants where they meet
    them. At most bits + 1 fingerprints can meet at a variant, however many texts there are."""
    met = _variants(firsts, near).groupBy("variant").agg(F.collect_list("a").alias("met")).where(F.size("met") > 1)
    at = met.select("variant", F.explode("met").alias("a")).groupBy("a").agg(F.collect_set("variant").alias("at"))
    return at.join(nodes.select(F.col("node").alias("a"), "size", "sketch"), "a")


def _met(members: DataFrame, near: Near, hubs: bool = False) -> DataFrame:
    """Pairs (a, b) of members (a, at, size, sketch, top) that meet at a variant, may be near and have different tops; with
    hubs for each member only that with the first of those before it, in an order by a hash. Sketches go to the variants once for
    each member there, so no row is made for a pair that they tell apart or that has one top."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, sizes = b.column(0).offsets.to_numpy(), b.column(0).value_lengths().to_numpy()
            node, order, top, size, sketches = b.column(0).values.flatten()
            node, order, top, size = (x.to_numpy() for x in (node, order, top, size))
            sketches = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(node), -1)
            for k in np.unique(sizes):
                left, right = np.triu_indices(k, 1)
                step = max(1, PIECE // 4 // len(left))
                of = starts[:-1][sizes == k]
                for at in range(0, len(of), step):
                    x, y = ((of[at : at + step, None] + side).ravel() for side in (left, right))
                    x, y = (side[top[x] != top[y]] for side in (x, y))
                    keep = may_be_near(sketches[x], sketches[y], near.similarity, (size[x], size[y]))
                    x, y = np.where(order[x] < order[y], x, y)[keep], np.where(order[x] < order[y], y, x)[keep]
                    if hubs:
                        by = np.lexsort((order[x], y))
                        by = by[np.unique(y[by], return_index=True)[1]]
                        x, y = x[by], y[by]
                    yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    each = members.select(F.struct("a", F.xxhash64("a").alias("order"), "top", "size", "sketch").alias("one"), F.explode("at").alias("variant"))
    met = each.groupBy("variant").agg(F.collect_list("one").alias("met")).where(F.size("met") > 1)
    pairs = met.select("met").mapInArrow(go, "a long, b long")
    if hubs:
        pairs = pairs.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a"))
    return pairs.select(*_ordered()).distinct()


#: Parts that hashes fall into, by their first bits; a sketch has a byte of the least hash of each.
PARTS = 64
#: Parts of the sketches that candidates are told apart by: so many that those of a short text hold nearly all of its hashes.
FINE = 256


def sketch(hashes: np.ndarray, parts: int = PARTS) -> bytes:
    """A byte for each part (a power of two) of a text's sorted hashes: from the least in it, or 0 where there is none. Two texts
    have the same byte in a part that either fills about as often as they share shingles."""
    out = np.zeros(parts, np.uint8)
    starts = np.searchsorted(hashes, np.arange(parts, dtype=np.uint64) << np.uint64(65 - parts.bit_length()))
    ends = np.append(starts[1:], len(hashes))
    some = np.flatnonzero(ends > starts)
    least = hashes[starts[some]] * np.uint64(0x9E3779B97F4A7C15)
    out[some] = 1 + (least >> np.uint64(40)) % np.uint64(255)
    return out.tobytes()


def may_be_near(one: np.ndarray, two: np.ndarray, similarity: float, sizes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which rows of two tables of sketches can be of texts of this similarity: all but those whose estimate is six standard
    deviations below it, which holds for one pair in forty million that is near.

    sizes are the numbers of hashes behind them. The parts' least hashes are drawn from all those of the two texts without putting
    any back, so the more of them the parts hold, the less the estimate varies; and near texts are of like size.
    """
    filled = ((one > 0) | (two > 0)).sum(axis=1)
    same = ((one == two) & (one > 0)).sum(axis=1)
    spread = np.sqrt(similarity * (1 - similarity) / np.maximum(filled, 1))
    if sizes is None:
        return same >= (similarity - 6 * spread) * filled
    every = (sizes[0] + sizes[1]) / (1 + similarity)
    spread *= np.sqrt(np.maximum(every - filled, 0) / np.maximum(every - 1, 1))
    like = np.minimum(*sizes) >= similarity * np.maximum(*sizes) - 1e-6
    return like & (same >= (similarity - 6 * spread) * filled - 1e-6)


def _likely(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Those of pairs (a, b) of nodes (node, size, sketch) that may be near."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (4, 5))
                sizes = b.column(2).to_numpy(), b.column(3).to_numpy()
                yield b.select(["a", "b"]).filter(pa.array(may_be_near(one, two, near.similarity, sizes)))

    for side in ("a", "b"):
        of = nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"of_{side}"))
        pairs = pairs.join(of, side)
    return pairs.select("a", "b", "size_a", "size_b", "of_a", "of_b").mapInArrow(go, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, near: Near, scratch: Scratch, name: str) -> DataFrame:
    """Those of pairs (a, b), none of them twice, that are near. sets: node, hashes.

    A node that is the first of very many has its pairs dealt out to several tasks.
    """
    pairs = scratch.table(pairs, f"{name}_likely")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).alias("parts"), F.count("*").alias("rows"))
    parts = scratch.table(parts, f"{name}_parts")
    # written, since lookup() and the join after it each read it, and would look every pair up again
    placed = scratch.table(lookup(pairs, parts, ["a"], "rows").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part")), f"{name}_placed")
    counts = placed.groupBy("b").agg(F.count("*").alias("rows"))
    other = lookup(placed, counts.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes")), "b"), ["b"], "rows", "inner")
    of_a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes"))
    first = parts.join(of_a, "a").select(F.col("a").alias("a"), "hashes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        keep: list[int] = []
        if left.num_rows and right.num_rows:
            one = np.frombuffer(right["hashes"][0].as_py(), "<u8")
            for b, data in zip(left["b"].to_pylist(), left["hashes"], strict=True):
                two = np.frombuffer(data.as_py(), "<u8")
                common = len(np.intersect1d(one, two, assume_unique=True))
                if common >= near.similarity * (len(one) + len(two) - common):
                    keep.append(b)
        return pa.table({"a": pa.array([left["a"][0].as_py()] * len(keep) if keep else [], pa.int64()), "b": pa.array(keep, pa.int64())})

    met = other.groupBy("a", "part").cogroup(first.groupBy("a", "part")).applyInArrow(go, "a long, b long")
    return scratch.table(met, name)


def near_groups(docs: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """One row for each different text of docs (doc_id, text): one, two (hashes of the text, null counting as empty),
    node, top (the node of the group's least id), doc_id (the text's least), mark (of the row that has it, the least), rows.

    Two texts are linked if their shares of common shingles reach near.similarity and a fingerprint of one is within 2
    bits of the other's; groups are what links connect. Among texts of one fingerprint, each is compared with the first, those
    that aren't near it with the next ones among themselves, and so on. The firsts of different fingerprints are compared, each
    with one of them at first, and with all of them that links don't connect by then: others would change no group.
    Texts without words are all alike.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes, sketches = [], [], []
            for t in values(b.column(4)):
                hashes = shingle_hashes(t, near.shingle)
                prints.append(short_prints(hashes, near))
                sizes.append(len(hashes))
                sketches.append(sketch(hashes, FINE))
            columns = [*(b.column(i) for i in range(4)), pa.array(prints, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "one", "two", "mark", "prints", "size", "sketch"])

    names = free_names(3, docs)
    marked = _marked(docs, *names)
    marked = marked.select("doc_id", *[F.col(a).alias(b) for a, b in zip(names, ("one", "two", "mark"), strict=True)], "text")
    rows = scratch.table(marked.mapInArrow(go, "doc_id long, one long, two long, mark long, prints array<long>, size long, sketch binary"), "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    nodes = rows.groupBy("one", "two").agg(least.alias("least"), F.count("*").alias("rows"), F.min("prints").alias("prints"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    nodes = nodes.select("one", "two", "least.doc_id", "least.mark", "rows", "prints", "size", "sketch").sortWithinPartitions("one", "two")
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    rows = nodes.select("node", F.explode(F.array_distinct("prints")).alias("print"))
    left = _first(rows, scratch, "first")
    firsts = scratch.spark.read.parquet(scratch.path("first_firsts")).select("print", F.col("firsts")[0].alias("a"))
    members = scratch.table(_members(firsts, nodes, near), "members")
    scratch.release()
    # all nodes that share a fingerprint or meet another: who else is compared later is among them
    named = left.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select(F.col("a").alias("node"))).distinct()
    wanted = scratch.table(nodes.join(named, "node").select("one", "two", "node", F.col("doc_id").alias("id"), F.col("mark").alias("of"), "rows"), "wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_hashes(t, near.shingle).astype("<u8").tobytes() for t in values(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["node", "hashes"])

    # a text's first row stands for all of them
    if wanted.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        texts = marked.join(F.broadcast(wanted.drop("rows")), ["one", "two"])
    else:
        texts = lookup(marked, wanted, ["one", "two"], "rows", "inner")
    texts = texts.where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of"))).select("node", "text")
    sets = scratch.table(texts.mapInArrow(hashed, "node long, hashes binary").dropDuplicates(["node"]), "sets")
    with small_batches(scratch.spark):
        hubs = scratch.table(_met(members.withColumn("top", F.col("a")), near, hubs=True), "hubs")
    pairs = _likely(left.select(*_ordered()).distinct(), nodes, near)
    edges = _verified(pairs.unionByName(hubs).distinct(), sets, near, scratch, "near0")
    # whoever shares a fingerprint with others but isn't near the first of them is compared with the next two, then the next
    # four, and so on, until none is left
    last, turn = edges, 0
    while True:
        near_one = left.join(last, ["a", "b"]).select("print", F.col("b").alias("node")).unionByName(
            left.join(last.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).select("print", F.col("b").alias("node"))
        )
        done = near_one.unionByName(left.select("print", F.col("a").alias("node"))).distinct()
        far = left.select("print", F.col("b").alias("node")).distinct().join(done, ["print", "node"], "left_anti")
        far = scratch.table(far, f"far{turn}")
        if not far.limit(1).count():
            break
        left = _first(far, scratch, f"again{turn}", 2 << turn)
        turn += 1
        last = _verified(_likely(left.select(*_ordered()).distinct(), nodes, near), sets, near, scratch, f"near{turn}")
        edges = edges.unionByName(last)
    of = scratch.table(components(nodes.select("node", F.col("doc_id").alias("rank")), edges, Scratch(scratch.spark, "linked")), "linked")
    of = _bridged(of, members, sets, near, scratch)
    return nodes.drop("prints", "size", "sketch").join(of, "node")


def _bridged(of: DataFrame, members: DataFrame, sets: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """node, top of all nodes, once all members that meet and are still in different groups of `of` (node, least, top) are compared."""
    tops = of.select(F.col("node").alias("a"), "top")
    with small_batches(scratch.spark):
        apart = scratch.table(_met(members.join(tops, "a"), near), "apart")
    found = _verified(apart, sets, near, scratch, "bridges")
    ends = found.join(tops.withColumnRenamed("top", "one"), "a").join(tops.withColumnsRenamed({"a": "b", "top": "two"}), "b")
    ends = scratch.table(ends.select(F.col("one").alias("a"), F.col("two").alias("b")).distinct(), "ends")
    if not ends.limit(1).count():
        return of.select("node", "top")
    touched = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    joined = components(of.join(touched, "node", "left_semi").select("node", F.col("least").alias("rank")), ends, Scratch(scratch.spark, "bridged"))
    moved = joined.where("node <> top").select(F.col("node").alias("top"), F.col("top").alias("onward"))
    moved = scratch.table(of.groupBy("top").agg(F.count("*").alias("rows")).join(moved, "top"), "moved")
    return lookup(of, moved, ["top"], "rows").select("node", F.coalesce("onward", "top").alias("top"))


def one_of_each(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """docs (all columns) without near-duplicates: of each group of near_groups() the row with the least id.

    Null ids come last. Among rows of the same id the one whose columns have the least hash stays, so reruns agree; of
    rows that are equal in all columns one does. Columns may have any names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    groups = scratch.table(near_groups(docs, near, scratch), "groups")
    scratch.release()
    names = free_names(6, docs)
    kept = groups.where("node = top").select("one", "two", F.col("doc_id").alias(names[4]), F.col("mark").alias(names[5]), F.col("rows").alias("rows"))
    kept = kept.withColumnsRenamed(dict(zip(("one", "two", "rows"), names[:3], strict=True)))
    found = lookup(_marked(docs, names[0], names[1], names[3]), kept, names[:2], names[2], "inner")
    found = found.where(F.col("doc_id").eqNullSafe(F.col(names[4])) & (F.col(names[3]) == F.col(names[5])))
    return found.dropDuplicates([names[0], names[1]]).select(*columns_of(docs))

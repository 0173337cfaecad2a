"""Near-duplicate embeddings by an exact metric range join.

Cosine >= t is Euclidean distance <= radius of the unit vectors. Pivots drawn from each label cut its vectors into
cells, each vector at home in the cell of its nearest pivot. The triangle inequality tells which other cells a vector
must be copied to: if y lies within the radius of some x at home in cell i, then d(y, p_i) <= d(y, p_home) + 2 radius;
for unit vectors the distance to the bisecting plane between the two pivots is the sharper form of the same bound,
and both are applied. Of two cells only one gets the other's vectors as copies, by their numbers, so each pair meets once:
the partners of a vector are at hand in its home cell, or it is itself at hand in theirs. Cells are joined independently.

The pivots of all labels are broadcast, MAX_PIVOTS of them at most. Cells that are still large are cut again in the
same way by pivots of their own, level by level, as long as a sample shows that it halves their work at least.

Equal vectors are made one, with their number, before the join. A cell with more vectors than a block holds is
joined block against block, in tasks of their own. A block gives the number of partners of each vector and a
spanning forest of its links, never a list of pairs, so a dense cell costs time but not rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components

from .common import Scratch, lookup, uniform

THRESHOLD = 0.98
#: Vectors that a cell shall hold; the most pivots over all labels (they are broadcast).
CELL, MAX_PIVOTS = 2_000, 4_096
#: Cells with more vectors at home than this are cut again, by so many pivots, in tasks of about so many vectors.
LARGE, FAN, TASK = 16_000, 64, 20_000
#: Vectors on each side of a block.
BLOCK = 2_048
#: More than rounding can move a distance or a cosine.
SLACK = 1e-9


def _vectors(vectors: pd.Series | list) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two so that its largest component lies in [0.5, 1): cosines stay as they
    are, to the last bit, and no square is too large or too small."""
    x = np.array(list(vectors), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _units(vectors: pd.Series | list) -> np.ndarray:
    x = _vectors(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _between(p: np.ndarray) -> np.ndarray:
    """Distances of pivots."""
    return np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 0))


def _members(x: np.ndarray, p: np.ndarray, between: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot of each vector, whether a vector must be in the cell of a pivot)."""
    d2 = 2 - 2 * np.clip(x @ p.T, -1, 1)
    home = d2.argmin(axis=1)
    rows = np.arange(len(x))
    own = d2[rows, home][:, None]
    triangle = np.sqrt(d2) - np.sqrt(own) <= 2 * radius + SLACK
    plane = d2 - own <= 2 * between[home] * radius + SLACK
    member = triangle & plane
    member[rows, home] = True
    return home, member


def _once(home: np.ndarray, cells: int) -> np.ndarray:
    """Whether vectors at home in a cell go to each other cell (or stay at home), and not that one's vectors to theirs. Every cell
    takes copies from about half of the others."""
    one, two = home[:, None], np.arange(cells)[None, :]
    return (one == two) | ((one > two) == ((one + two) % 2 == 0))


def _pivots(distinct: DataFrame) -> dict[str, np.ndarray]:
    """Unit vectors of the pivots of each label: every vector is drawn with the same chance, by a hash."""
    sizes = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_PIVOTS).collect()}
    share = min(1 / CELL, MAX_PIVOTS / 2 / max(1, sum(sizes.values())))
    limits = {k: max(1, round(n * share)) for k, n in sizes.items()}
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in limits.items() for x in (k, sizes[k] and min(1.0, 2 * n / sizes[k] + 20 / sizes[k]))]), F.col("label"))
    near = distinct.where(F.col("u") < F.coalesce(chance, F.lit(0.0)))
    found: dict[str, list] = {}
    for r in near.select("label", "u", "embedding").orderBy("label", "u").collect():  # a few for each pivot
        found.setdefault(r["label"], []).append(r["embedding"])
    return {k: _units(v[: limits[k]]) for k, v in found.items()}


def _assign(pivots: dict[str, np.ndarray], radius: float):
    """Cells of vectors: one row at home and one for each cell that a vector is copied to."""
    first, spare = {}, 0
    for k, p in pivots.items():
        first[k], spare = spare, spare + len(p)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        between: dict[str, np.ndarray] = {}
        for all_ in frames:
            for label, f in all_.groupby("label"):
                p = pivots.get(label)
                if p is None:  # such a label shares a cell with others; the block keeps them apart
                    yield f.assign(cell=spare + f["spare"], home=True)
                    continue
                if label not in between:
                    between[label] = _between(p)
                for at in range(0, len(f), 1_000):
                    g = f.iloc[at : at + 1_000]
                    home, member = _members(_units(g["embedding"]), p, between[label], radius)
                    r, c = np.nonzero(member & _once(home, len(p)))
                    yield g.iloc[r].assign(cell=first[label] + c, home=c == home[r])

    return go


def _plan(radius: float):
    """A sample of a cell's vectors at home to its pivots, or to none where cutting the cell wouldn't halve its work."""

    def go(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["u", "node"])
        x = _units(f["embedding"])
        p, others = x[:FAN], x[FAN:]
        if len(others):
            home, member = _members(others, p, _between(p), radius)
            member &= _once(home, len(p))
            work = (np.bincount(home, minlength=len(p)) / len(others) * member.mean(axis=0)).sum()
            if work <= 0.5:
                return pd.DataFrame({"cell": int(key[0]), "k": np.arange(len(p)), "pivot": list(p)})
        return pd.DataFrame({"cell": pd.Series(dtype="int64"), "k": pd.Series(dtype="int64"), "pivot": pd.Series(dtype=object)})

    return go


def _cut(radius: float, columns: list[str]):
    """Rows of a cell and its pivots to rows of smaller cells. Where a vector was a copy it stays one, and goes to all cells that
    may hold partners, since none of those comes to it."""

    def go(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows[columns]
        p = np.array(list(pivots.sort_values("k")["pivot"]))
        between, out = _between(p), []
        for at in range(0, len(rows), 1_000):
            f = rows.iloc[at : at + 1_000]
            home, member = _members(_units(f["embedding"]), p, between, radius)
            member &= _once(home, len(p)) | ~f["home"].to_numpy(bool)[:, None]
            r, c = np.nonzero(member)
            g = f.iloc[r]
            out.append(g.assign(cell=(g["cell"].to_numpy() + 1) * FAN + c, home=g["home"].to_numpy() & (c == home[r])))
        return pd.concat(out)[columns]

    return go


def _cells(source: DataFrame, radius: float, scratch: Scratch) -> DataFrame:
    """source (node, times, label, embedding, u, spare) with level, cell, home: every vector once at home, and in all the
    other cells where partners of it are at home."""
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", cell long, home boolean"
    now = scratch.table(source.mapInPandas(_assign(_pivots(source), radius), schema), "cells0")
    done: list[DataFrame] = []
    for level in count():
        named = lambda rows: rows.withColumn("level", F.lit(level))  # noqa: B023, E731
        sizes = scratch.table(now.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("at_home")), f"sizes{level}")
        large = sizes.where(F.col("at_home") > LARGE)
        if not large.limit(1).count():
            done.append(named(now))
            break
        # about 512 of each large cell, which are few in comparison
        sample = lookup(now.where("home"), sizes.select("cell", "at_home", "rows"), ["cell"], "rows").where((F.col("at_home") > LARGE) & (F.col("u") * F.col("at_home") < F.lit(8 * FAN)))
        pivots = scratch.table(sample.select("cell", "u", "node", "embedding").groupBy("cell").applyInPandas(_plan(radius), "cell long, k long, pivot array<double>"), f"pivots{level}")
        cut = scratch.table(pivots.select("cell").distinct().join(sizes, "cell").withColumn("parts", F.ceil(F.col("rows") / TASK)), f"cut{level}")
        if not cut.limit(1).count():
            done.append(named(now))
            break
        placed = lookup(now, sizes.select("cell", "rows").join(cut.select("cell", "parts"), "cell", "left"), ["cell"], "rows")
        placed = scratch.table(placed, f"placed{level}")
        done.append(named(placed.where("parts is null").drop("parts")))
        rows = placed.where("parts is not null").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "node"), "parts")).drop("parts")
        each = pivots.join(cut.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        met = rows.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInPandas(_cut(radius, now.columns), schema)
        now = scratch.table(met, f"cells{level + 1}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component among n nodes joined by pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join(threshold: float):
    def go(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([of_label(g) for _, g in f.groupby("label")])

    def of_label(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] == 0], f[f["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({k: pd.Series(dtype="int64") for k in ("node", "links", "root")})  # 64-bit names bear no other type
        raw_a, raw_b = _vectors(left["embedding"]), _vectors(right["embedding"])
        norm_a, norm_b = np.linalg.norm(raw_a, axis=1), np.linalg.norm(raw_b, axis=1)
        a, b, times_a, times_b = left["node"].to_numpy(), right["node"].to_numpy(), left["times"].to_numpy(), right["times"].to_numpy()
        # a copy meets its partner here alone; of two vectors at home each comes on both sides
        links, of_copies, copy, pairs = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), ~right["home"].to_numpy(bool), []
        for at in range(0, len(a), 512):
            cos = (raw_a[at : at + 512] @ raw_b.T) / np.outer(norm_a[at : at + 512], norm_b)
            i, j = np.nonzero(cos >= threshold - SLACK)
            near = np.abs(cos[i, j] - threshold) <= SLACK  # too close to tell from the product of matrices
            if near.any():
                exact = np.array([float(np.sum(raw_a[at + x] * raw_b[y])) / float(np.sqrt(np.sum(raw_a[at + x] ** 2) * np.sum(raw_b[y] ** 2))) for x, y in zip(i[near], j[near], strict=True)])
                keep = np.ones(len(i), bool)
                keep[near] = exact >= threshold
                i, j = i[keep], j[keep]
            other = a[at + i] != b[j]
            i, j = i[other], j[other]
            np.add.at(links, at + i, times_b[j])
            here = copy[j]
            np.add.at(of_copies, j[here], times_a[at + i[here]])
            pairs.append((at + i, j))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        root = names[_forest(place[i], place[len(a) + j], len(names))]
        of_a = pd.DataFrame({"node": a, "links": links, "root": root[place[: len(a)]]})
        of_b = pd.DataFrame({"node": b, "links": of_copies, "root": root[place[len(a) :]]})
        every = pd.concat([of_a, of_b])
        return every[(every["links"] > 0) | (every["root"] != every["node"])]

    return go


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and the cosine is at least the threshold. n_links counts
    the other rows linked to a row directly, equal vectors among them; component_id is the least vec_id within
    reach. Vectors that are null, empty or zero or hold a null, NaN or infinity, and rows without a label, link with
    nothing, and vectors of different length don't link; how long a vector is in the geometric sense makes no odds. Rows that repeat count each for itself. A null vec_id is
    never a component's id unless the component has no other.
    """
    if not 0.5 < threshold < 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    scratch = Scratch(vectors.sparkSession, "metric")
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    fit = F.col("label").isNotNull() & whole & F.exists(x, lambda e: e != 0)
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(fit, F.lit(False)).alias("fit"))
    rows = scratch.table(rows, "rows")
    fits = rows.where("fit")
    distinct = fits.groupBy("label", "embedding").agg(F.min("vec_id").alias("rank"), F.count("*").alias("times"))
    # numbered as they are written, so no two vectors share a number
    distinct = scratch.table(distinct.withColumns({"node": F.monotonically_increasing_id(), "u": uniform(F.lit(2), F.col("label"), F.col("embedding"))}), "distinct")

    # vectors of different length are kept apart like those of different labels
    kind = F.concat_ws(":", F.size("embedding"), F.col("label"))
    source = distinct.select("node", "times", kind.alias("label"), "embedding", "u", F.crc32(kind).alias("spare"))
    radius = float(np.sqrt(2 - 2 * threshold))
    cells = _cells(source, radius, scratch)
    # blocks of a cell: rows at home against all rows, both dealt out by a hash of the vector
    at = ["level", "cell"]
    counts = cells.groupBy(*at).agg(F.count("*").alias("rows"), F.ceil(F.count_if("home") / BLOCK).alias("na"), F.ceil(F.count("*") / BLOCK).alias("nb"))
    placed = lookup(cells, scratch.table(counts, "counts"), at, "rows")
    spread = F.xxhash64(F.lit(3), "node")
    at_home = placed.where("home").select("*", F.lit(0).alias("side"), F.pmod(spread, "na").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("j"))
    anyone = placed.where("na > 0").select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)).alias("i"), F.pmod(spread, "nb").alias("j"))
    both = at_home.unionByName(anyone).select("node", "label", "times", "embedding", "home", "side", *at, "i", "j")
    met = both.groupBy(*at, "i", "j").applyInPandas(_join(threshold), "node long, links long, root long")
    met = scratch.table(met, "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    of = components(distinct.select("node", "rank"), met.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    found = distinct.join(of, "node").join(links, "node", "left").select(
        "label", "embedding", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.col("least").alias("component_id")
    )
    found = scratch.table(found, "found")
    linked = lookup(fits, found, ["label", "embedding"], "times").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

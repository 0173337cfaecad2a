"""Periodic runs in texts, by the linear tandem-repeat method of Gusfield and Stoye.

A tandem repeat is a stretch that consists of two equal halves. The method goes in three phases over a sequence of
numbers:

1. The sequence is cut into Lempel-Ziv blocks (the longest stretch that began before, else one new number). The leftmost
   occurrence of every tandem repeat lies across a border of blocks, near enough to be found by common extensions
   to both sides of the border: a few repeats that cover all leftmost ones.
2. Each of those is located in the suffix tree.
3. From there suffix links are walked: a repeat that starts with w and goes on with w after its end gives the next one, its
   rotation. What is reached is the vocabulary: every different tandem repeat, as a place in the tree.

The leaves below a place are the repeat's occurrences. Occurrences of one period that start one after another merge
into a run. Only repeats of primitive halves are walked, so a run's period is its smallest.

The suffix tree is a suffix array with its intervals of common prefixes; common extensions are minima over an interval.
All of that is linear in memory. Texts are gone through in two steps: a run of some length repeats a stretch of
half that length or more, so what lies outside of repeated stretches can't be in a run (hashes of all stretches tell); what is
left of many texts is put together, with numbers between that occur once, and the method is applied to it as one sequence.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

#: A run: start, length, period.
Run = tuple[int, int, int]

#: Words of parts of texts that are gone through as one sequence; a longer part is one by itself.
TOGETHER = 1 << 15
#: Places of a lookup of minima that are compared one by one.
BLOCK = 16


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of s in order, and each suffix's place in that order; by doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while True:
        sorted_ = rank[order]
        if n < 2 or (np.diff(sorted_) > 0).all():
            return order, rank
        after = np.full(n, 0, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        # only suffixes that aren't alone yet need to be told apart
        same = np.zeros(n, bool)
        equal = np.diff(sorted_) == 0
        same[1:] |= equal
        same[:-1] |= equal
        at = np.flatnonzero(same)
        part = order[at]
        key = rank[part] * (n + 1) + after[part]
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[at] = part
        # a rank is the place of the first suffix that is equal so far
        new = np.r_[True, np.diff(key) > 0]
        rank[part] = np.maximum.accumulate(np.where(new, at, 0))
        if width == 1:
            alone = np.flatnonzero(~same)
            rank[order[alone]] = alone
        width *= 2


def common_prefixes(s: list[int], order: list[int], rank: list[int]) -> np.ndarray:
    """Of each suffix in order, the length that it has in common with the one before it."""
    n, h = len(s), 0
    out = array("q", bytes(8 * n))
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            most = n - max(i, j)
            while h < most and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return np.frombuffer(out, np.int64)


class Extensions:
    """Lengths of common prefixes of suffixes, for many pairs at once."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        self.order, self.rank = suffix_array(s)
        self.lcp = common_prefixes(s.tolist(), self.order.tolist(), self.rank.tolist())
        blocks = -(-self.n // BLOCK)
        padded = np.full(blocks * BLOCK, self.n, np.int64)
        padded[: self.n] = self.lcp
        grid = padded.reshape(blocks, BLOCK)
        self.padded = padded
        self.head = np.minimum.accumulate(grid, axis=1).ravel()  # from the block's begin to here
        self.tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def minima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of lcp[a..b], both included, a <= b."""
        one, two = a // BLOCK, b // BLOCK
        out = np.minimum(self.tail[a], self.head[b])
        near = np.flatnonzero(one == two)
        if len(near):
            x, y = a[near], b[near]
            least = self.padded[x]
            for step in range(1, BLOCK):
                at = np.minimum(x + step, y)
                least = np.minimum(least, self.padded[at])
            out[near] = least
        far = np.flatnonzero(two - one > 1)
        if len(far):
            x, y = one[far] + 1, two[far]
            level = np.frexp(y - x)[1] - 1
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                least = np.minimum(self.levels[k][x[at]], self.levels[k][y[at] - (1 << k)])
                out[far[at]] = np.minimum(out[far[at]], least)
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at i and j; one that begins at the end has none."""
        out = np.zeros(len(i), np.int64)
        at = np.flatnonzero((i < self.n) & (j < self.n))
        x, y = self.rank[i[at]], self.rank[j[at]]
        same = x == y
        low, high = np.minimum(x, y), np.maximum(x, y)
        found = self.minima(np.minimum(low + 1, high), high)
        out[at] = np.where(same, self.n - i[at], found)
        return out


def blocks(ext: Extensions) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    n, order = ext.n, ext.order.tolist()
    before, after = array("q", [-1]) * n, array("q", [-1]) * n
    open_: list[int] = []  # of the suffixes so far in order, those whose start is below all that came later
    for i in order:
        while open_ and open_[-1] > i:
            after[open_.pop()] = i
        if open_:
            before[i] = open_[-1]
        open_.append(i)
    # the longest earlier occurrence is that of the nearest suffix, on either side, that starts earlier
    at = np.arange(n)
    longest = np.zeros(n, np.int64)
    for earlier in (np.frombuffer(before, np.int64), np.frombuffer(after, np.int64)):
        some = np.flatnonzero(earlier >= 0)
        longest[some] = np.maximum(longest[some], ext(at[some], earlier[some]))
    steps, out, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:
        out.append(i)
        i += steps[i]
    return np.array([*out, n], np.int64)


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of, k): k = 1..counts[of] for every of."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def covering(ext: Extensions, back: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of tandem repeats that cover the leftmost occurrence of every tandem repeat.

    back: extensions of the reversed sequence. A repeat's middle lies in one block, or at its end. If its first half lies in
    that block as well, its second half holds the block's end; else its first half holds the block's begin.
    """
    n, border = ext.n, blocks(ext)
    h, end = border[:-1], border[1:]
    length = end - h
    backward = lambda i, j: back(n - 1 - i, n - 1 - j)  # common stretch that ends at i and at j

    # the second half holds the block's end
    of, k = _counted(np.where(end < n, length, 0))
    b, q = end[of], end[of] - k
    right, left = ext(q, b), np.where(q > 0, backward(np.maximum(q - 1, 0), b - 1), 0)
    start = np.maximum(q - left, q - k + 1)
    ok = (left + right >= k) & (right > 0)
    starts, periods = [start[ok]], [k[ok]]

    # the first half holds the block's begin, and begins before it
    following = np.append(length[1:], 0)
    of, k = _counted(np.where(h > 0, np.minimum(length + following, n - 1 - h), 0))
    a, q = h[of], h[of] + k
    right, left = ext(a, q), backward(a - 1, q - 1)
    start = np.maximum(a - left, a - k + 1)
    ok = (left + right >= k) & (right > 0) & (left > 0) & (start + k <= end[of])
    return np.concatenate([*starts, start[ok]]), np.concatenate([*periods, k[ok]])


def primitive(ext: Extensions, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether the halves aren't repetitions of something shorter themselves."""
    out = np.ones(len(starts), bool)

    def check(at: np.ndarray, primes: np.ndarray | int) -> None:
        i, q = starts[at], periods[at]
        part = q // primes
        out[at[ext(i, i + part) >= q - part]] = False

    left, p = periods.copy(), 2
    while len(left) and p * p <= left.max():
        # what smaller primes divide is divided out before, so only primes divide
        divides = np.flatnonzero(left % p == 0)
        if len(divides):
            check(divides, p)
            while len(divides):
                left[divides] //= p
                divides = divides[left[divides] % p == 0]
        p += 1
    rest = np.flatnonzero(left > 1)  # primes
    check(rest, left[rest])
    return out


class Tree:
    """Suffix tree over the intervals of the suffix array. Nodes below n are leaves, by place in the order."""

    def __init__(self, ext: Extensions):
        self.n = n = ext.n
        self.order, self.rank = ext.order.tolist(), ext.rank.tolist()
        self.low, self.high, self.depth, self.parent = (array("q") for _ in range(4))
        for r, i in enumerate(self.order):
            self.low.append(r)
            self.high.append(r)
            self.depth.append(n - i)
            self.parent.append(-1)
        self.link: dict[int, int] = {}
        root = self._node(0)
        open_ = [root]
        lcp = ext.lcp.tolist()
        for r in range(n):
            # node: what hangs below the interval that is open at this depth
            depth, node = lcp[r] if r else 0, r - 1
            while r and self.depth[open_[-1]] > depth:
                done = open_.pop()
                self.high[done] = r - 1
                self.parent[node] = done
                node = done
            if r and self.depth[open_[-1]] < depth:
                new = self._node(self.low[node])
                self.depth[new] = depth
                open_.append(new)
            if r:
                self.parent[node] = open_[-1]
        node = n - 1
        while open_:
            done = open_.pop()
            self.high[done] = n - 1
            if node != done:
                self.parent[node] = done
            node = done
        self.root = root

    def _node(self, low: int) -> int:
        self.low.append(low)
        self.high.append(low)
        self.depth.append(0)
        self.parent.append(-1)
        return len(self.low) - 1

    def up(self, node: int, length: int) -> int:
        """The highest node above (or at) node that is at least so deep: the place of its first `length` numbers."""
        parent, depth = self.parent, self.depth
        while (p := parent[node]) >= 0 and depth[p] >= length:
            node = p
        return node

    def suffix_link(self, node: int) -> int:
        """Where node's string without its first number ends: a node, or the leaf of what is left."""
        if node < self.n:
            return self.rank[self.order[node] + 1]
        found = self.link.get(node)
        if found is None:
            i = self.order[self.low[node]] + 1
            found = self.link[node] = self.up(self.rank[i], self.depth[node] - 1)
        return found

    def child(self, s: list[int], node: int, number: int) -> int | None:
        """The node below node to whose string number comes next."""
        depth, order = self.depth[node], self.order
        low = self.low[node]
        if order[low] + depth >= self.n:  # this suffix ends here
            low += 1
        at = bisect_left(range(low, self.high[node] + 1), number, key=lambda r: s[order[r] + depth]) + low
        if at > self.high[node] or s[order[at] + depth] != number:
            return None
        return self.up(at, depth + 1)


def vocabulary(s: list[int], tree: Tree, starts: list[int], periods: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(first, last, period): intervals of the suffix array that hold the occurrences of every different tandem repeat of
    a primitive half; starts and periods: repeats that cover the leftmost ones."""
    seen: set[tuple[int, int]] = set()
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for i, q in zip(starts, periods, strict=True):
        node = tree.up(tree.rank[i], 2 * q)
        while (node, q) not in seen:
            seen.add((node, q))
            out[0].append(tree.low[node])
            out[1].append(tree.high[node])
            out[2].append(q)
            # the same without its first number, and then that number again?
            at = tree.order[tree.low[node]]
            number, length = s[at], 2 * q - 1
            place = tree.up(tree.suffix_link(node), length)
            if tree.depth[place] == length:
                onward = tree.child(s, place, number)
            else:
                begin = tree.order[tree.low[place]] + length
                onward = place if s[begin] == number else None
            if onward is None:
                break
            node = onward
    return out


def runs_of(s: np.ndarray, least: int, times: int) -> list[Run]:
    """All runs of s (numbers) of a length of at least max(least, times * period), times being 2 or more, by start, then
    period."""
    n = len(s)
    if n < 2:
        return []
    ext, back = Extensions(s), Extensions(s[::-1])
    starts, periods = covering(ext, back)
    keep = primitive(ext, starts, periods)
    starts, periods = starts[keep], periods[keep]
    if not len(starts):
        return []
    first, last, period = (np.array(x, np.int64) for x in vocabulary(s.tolist(), Tree(ext), starts.tolist(), periods.tolist()))
    count = last - first + 1
    of, k = _counted(count)
    at, q = ext.order[first[of] + k - 1], period[of]
    by = np.lexsort((at, q))
    at, q = at[by], q[by]
    new = np.r_[True, (np.diff(q) != 0) | (np.diff(at) != 1)]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(at)])
    start, q = at[begin], q[begin]
    length = size - 1 + 2 * q
    found = np.flatnonzero(length >= np.maximum(least, times * q))
    by = found[np.lexsort((q[found], start[found]))]
    return list(zip(start[by].tolist(), length[by].tolist(), q[by].tolist(), strict=True))


def repeated_parts(hashes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Parts (begin, end) of a text outside of which no run can lie. hashes: of its words.

    A run of length L and period q repeats L - q words, at least g = least * (times - 1) / times. Its words all lie in stretches
    of g words that occur more than once, which touch one another. Equal stretches have equal hashes.
    """
    g = 1 << (max(1, least - least // times).bit_length() - 1)
    n = len(hashes) - g + 1
    if n < 2:
        return []
    mixed, width = hashes.astype(np.uint64), 1
    while width < g:
        m = len(mixed) - width
        mixed = (mixed[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed[width:] + (mixed[width:] >> np.uint64(29)))
        width *= 2
    sorted_ = np.sort(mixed)
    twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    if not len(twice):
        return []
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    place = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
    at = np.flatnonzero(twice[place] == mixed)
    cut = np.flatnonzero(np.diff(at) > g) + 1
    return [(int(a[0]), int(a[-1]) + g) for a in np.split(at, cut)]


def runs_of_texts(texts: list[list[bytes]], least: int, times: int) -> list[list[Run]]:
    """The runs of each text, given as words; by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    now: list[tuple[int, int, int]] = []  # text, begin, end
    size = 0

    def go() -> None:
        """The parts as one sequence, with numbers between them that occur once."""
        number: dict[bytes, int] = {}
        s, places = [], []
        for k, (of, a, b) in enumerate(now):
            places.append(len(s))
            s += [number.setdefault(w, len(number)) for w in texts[of][a:b]]
            s.append(-1 - k)
        for start, length, q in runs_of(np.array(s, np.int64), least, times):
            k = int(np.searchsorted(places, start, "right")) - 1
            of, a, _ = now[k]
            out[of].append((a + start - places[k], length, q))
        now.clear()

    for of, words in enumerate(texts):
        if len(words) < least:
            continue
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        for a, b in repeated_parts(hashes, least, times):
            if now and size + b - a > TOGETHER:
                go()
                size = 0
            now.append((of, a, b))
            size += b - a
    if now:
        go()
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def words_of(text: str | None) -> list[bytes]:
    """Runs between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse(docs: DataFrame, least: int = 24, times: int = 3, change=None) -> DataFrame:
    """doc_id, runs (start, length, period, counted in words; by start, then period) and collapsed (the words that no run
    holds after its first period, joined by single spaces) of every row of docs (doc_id, text).

    A run is a stretch of words with smallest period q and a length of at least max(least, times * q) that can't be made
    longer. Null and empty texts have no words. Rows that repeat and null ids are rows like others. A text of any length is
    gone through in one task, in memory linear in its length. change: what is done to a document's words before, from
    (doc_id, words). An empty table gives no row.
    """
    if times < 2:
        raise ValueError("a run has two periods or more")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_texts(texts, least, times)
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
        out = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, kind), pa.array(out, pa.string())], ["doc_id", "runs", "collapsed"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
                words = words_of(text)
                ids.append(doc_id)
                texts.append(change(doc_id, words) if change else words)
                size += len(words)
                if size >= 4 * TOGETHER:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        yield flush(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(go, SCHEMA)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, whose id may say that they repeat from some word on; a null id says nothing."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[: a + p]
    period = head[a:]
    return (head[:a] + period * (-(-(n - a) // len(period))))[:n] if period else words


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the run with the greatest length by period, else null),
    runs_sha256 (of start,length,period and a line end for each run), collapsed_sha256, of collapse()'s rows."""
    # runs come by start, then period, so the first of several that are equally great stays
    first = F.get("runs", F.lit(0))
    top = F.reduce("runs", first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    # the remainder goes first, so that the division is exact
    thousands = F.lit(1000) * F.col("top.length")
    exponent = (thousands - F.pmod(thousands, F.col("top.period"))) / F.col("top.period")
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period", exponent.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

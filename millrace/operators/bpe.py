"""Byte-level BPE: counting, training, encoding, decoding."""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.scratch import Scratch

#: Bytes of distinct words that the driver trains on, which take some hundred times that; more are left on the executors.
MAX_DRIVER_BYTES = 4_000_000
#: Words whose ids a worker keeps.
CACHE = 1_000_000


def word_counts(docs: DataFrame, specials: list[str] | None = None) -> DataFrame:
    """word, n: pre-tokens of all texts, special tokens aside. Counts are added up before the one shuffle."""
    parts = tx.split_special(F.col("text"), specials, keep=False) if specials else F.array("text")
    words = F.flatten(F.transform(parts, tx.pretokens))
    return docs.where(F.col("text").isNotNull()).select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right (hex of one byte each), n: adjacent bytes in words (word, n), each as often as its word."""
    data = F.regexp_extract_all(F.hex(F.encode("word", "UTF-8")), F.lit(".."), F.lit(0))
    rows = words.select(data.alias("d"), "n").where(F.size("d") > 1)
    pairs = F.zip_with(F.slice("d", 1, F.size("d") - 1), F.slice("d", 2, F.size("d") - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return rows.select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def first_merge(pairs: DataFrame) -> DataFrame:
    """The pair with the greatest count, ties to the greatest bytes."""
    best = F.max(F.struct("n", "left", "right")).alias("b")
    return pairs.agg(best).where("b is not null").select("b.left", "b.right", "b.n")


def _order(token: bytes) -> tuple[int, ...]:
    """Sorts greater bytes first, and longer ones before their own beginnings."""
    return (*(255 - b for b in token), 256)


def learn(counts: dict[str, int], merges: int) -> list[tuple[bytes, bytes]]:
    """Merges learned from words and their counts: each time the most frequent pair, ties to the greatest bytes.

    Symbols are numbers. Only words that hold the merged pair are looked at again, and in those only the pairs beside
    the places of the merge change their counts; the heap may hold outdated entries, which are put back with their
    true count when they come up.
    """
    tokens = [bytes([b]) for b in range(256)]
    order = [_order(t) for t in tokens]
    words = [(list(w.encode("utf-8")), n) for w, n in counts.items() if w]
    total: dict[tuple[int, int], int] = defaultdict(int)
    inside: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, (symbols, n) in enumerate(words):
        for pair in zip(symbols, symbols[1:]):  # noqa: B905
            total[pair] += n
            inside[pair].add(k)
    entry = lambda pair: (-total[pair], order[pair[0]], order[pair[1]], pair)
    heap = [entry(p) for p in total]
    heapq.heapify(heap)
    learned: list[tuple[bytes, bytes]] = []
    while heap and len(learned) < merges:
        n, _, _, pair = heapq.heappop(heap)
        if -n != total[pair]:
            if total[pair] > 0:
                heapq.heappush(heap, entry(pair))
            continue
        a, b = pair
        learned.append((tokens[a], tokens[b]))
        made = len(tokens)
        tokens.append(tokens[a] + tokens[b])
        order.append(_order(tokens[made]))
        grown = set()
        for k in inside.pop(pair):
            symbols, times = words[k]
            at = 0
            while True:
                try:
                    at = symbols.index(a, at)
                except ValueError:
                    break
                if at + 1 >= len(symbols) or symbols[at + 1] != b:
                    at += 1
                    continue
                symbols[at : at + 2] = [made]
                if at:
                    left = symbols[at - 1]
                    total[left, a] -= times
                    total[left, made] += times
                    inside[left, made].add(k)
                    grown.add((left, made))
                if at + 1 < len(symbols):
                    right = symbols[at + 1]
                    total[b, right] -= times
                    total[made, right] += times
                    inside[made, right].add(k)
                    grown.add((made, right))
                at += 1
        del total[pair]
        for p in grown:
            if total[p] > 0:
                heapq.heappush(heap, entry(p))
    return learned


def merge(symbols: list[bytes], pair: tuple[bytes, bytes]) -> list[bytes]:
    """symbols with every occurrence of pair made one, from the left."""
    out, k = [], 0
    while k < len(symbols):
        if k + 1 < len(symbols) and symbols[k] == pair[0] and symbols[k + 1] == pair[1]:
            out.append(pair[0] + pair[1])
            k += 2
        else:
            out.append(symbols[k])
            k += 1
    return out


def train(docs: DataFrame, vocab_size: int, specials: list[str] | None = None, max_driver_bytes: int = MAX_DRIVER_BYTES) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    """Vocabulary (bytes, then merges, then special tokens) and merges of docs (text). Null texts are left out."""
    specials = specials or []
    merges = max(0, vocab_size - 256 - len(specials))
    words = word_counts(docs, specials)
    scratch = Scratch(docs.sparkSession, "bpe")
    words = scratch.table(words, "words")
    if (words.agg(F.sum(F.octet_length("word"))).first()[0] or 0) <= max_driver_bytes:
        local = words.toArrow()
        learned = learn(dict(zip(local["word"].to_pylist(), local["n"].to_pylist(), strict=True)), merges)
    else:
        from millrace.operators import merging

        bytes_, slots = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0, merging.slots(docs.sparkSession)
        if slots and merges:
            learned = merging.learn(words, merges, max(1, min(slots, -(-bytes_ // merging.SHARE))))
        else:
            learned = _learn_spread(words, merges, scratch)
    tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in learned] + [s.encode("utf-8") for s in specials]
    return dict(enumerate(tokens)), learned


class Pairs:
    """Counts of adjacent pairs of symbols, and the merges that come next. Symbols are numbers; the first 256 are bytes.

    kept: pairs that are held at most, those that count most; floor is the least count of which all are held. A pair's count only
    falls once its symbols are there, so one that is below the floor never comes up to it.
    """

    def __init__(self, kept: int | None = None):
        self.kept, self.floor = kept, 1
        self.tokens = [bytes([b]) for b in range(256)]
        self.order = [_order(t) for t in self.tokens]
        self.total: dict[tuple[int, int], int] = defaultdict(int)
        self.after: dict[int, set[int]] = defaultdict(set)  # what has followed a symbol
        self.before: dict[int, set[int]] = defaultdict(set)
        self.heap: list[tuple] = []

    def _entry(self, pair: tuple[int, int]) -> tuple:
        return -self.total[pair], self.order[pair[0]], self.order[pair[1]], pair

    def add(self, lefts: Iterable[int], rights: Iterable[int], changes: Iterable[int]) -> None:
        for a, b, n in zip(lefts, rights, changes, strict=True):
            self.total[a, b] += n
            if self.total[a, b] >= self.floor:
                self.after[a].add(b)
                self.before[b].add(a)
                if n > 0:  # else its entry is put back with its count when it comes up
                    heapq.heappush(self.heap, self._entry((a, b)))
            else:
                del self.total[a, b]
                self.after[a].discard(b)
                self.before[b].discard(a)

    def begin(self, keys: np.ndarray, counts: np.ndarray, floor: int) -> None:
        """Hold these pairs (left << 32 | right) in place of all, which are all that count as much as the floor."""
        self.floor = floor
        if self.kept and np.count_nonzero(counts >= floor) > self.kept:
            self.floor = int(np.partition(counts, -self.kept // 2)[-self.kept // 2])
        for x in (self.total, self.after, self.before, self.heap):
            x.clear()
        some = counts >= self.floor
        self.add((keys[some] >> 32).tolist(), (keys[some] & 0xFFFFFFFF).tolist(), counts[some].tolist())

    def change(self, keys: np.ndarray, changes: np.ndarray) -> None:
        """Add changes of pairs (left << 32 | right). New pairs below the floor, and what others lose that aren't held, are left out."""
        some = (changes >= self.floor) | (changes < 0)
        rows = zip((keys[some] >> 32).tolist(), (keys[some] & 0xFFFFFFFF).tolist(), changes[some].tolist(), strict=True)
        rows = [r for r in rows if r[2] > 0 or r[:2] in self.total]
        if rows:
            self.add(*zip(*rows, strict=True))
        if self.kept and len(self.total) > self.kept:
            pairs, counts = list(self.total), np.fromiter(self.total.values(), np.int64, len(self.total))
            self.begin(np.array([a << 32 | b for a, b in pairs], np.int64), counts, self.floor)

    def next(self, most: int) -> list[tuple[int, int]]:
        """The next merges, as many as are certain before any of them is made; each gets a new symbol.

        A pair comes next if it shares no end with an earlier one of them (then its count stays) and no pair that those
        make can come before it. A made pair is at most as frequent as the pair of symbols that it comes from, which was not
        above the next one; where it may be as frequent, its bytes decide.
        """
        out: list[tuple[int, int]] = []
        lefts: set[int] = set()
        rights: set[int] = set()
        made: dict[int, list[tuple]] = defaultdict(list)  # orders of pairs that may come up, by the most that they can count
        while self.heap and len(out) < most:
            n, *of, pair = entry = heapq.heappop(self.heap)
            if -n != self.total.get(pair, 0):
                if pair in self.total:  # an outdated entry
                    heapq.heappush(self.heap, self._entry(pair))
                continue
            if self.heap and self.heap[0] == entry:
                continue
            a, b = pair
            if a in rights or b in lefts or any(o <= tuple(of) for o in made[-n]):
                heapq.heappush(self.heap, entry)
                break
            out.append(pair)
            token = self.tokens[a] + self.tokens[b]
            self.tokens.append(token)
            order = _order(token)
            self.order.append(order)
            lefts.add(a)
            rights.add(b)
            for x in self.before[a]:
                made[self.total[x, a]].append((self.order[x], order) if x not in rights else ((), ()))
            for y in self.after[b]:
                made[self.total[b, y]].append((order, self.order[y]) if y not in lefts else ((), ()))
            if a == b:
                break  # in long runs the made symbol follows itself, as often as half of what the pair counted
        return out


def _apply(symbols: np.ndarray, counts: np.ndarray, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols after the merges of a batch (left, right, made), keys of pairs whose counts change, by how much).

    symbols: words one after another, each ended by -1; counts: of the words. No two merges of a batch meet at a symbol.
    """
    by = sorted((a << 32 | b, c) for a, b, c in batch)
    keys, made = (np.array(x, np.int64) for x in zip(*by, strict=True))
    pairs = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
    pairs[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
    which = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    at = np.flatnonzero(keys[which] == pairs)
    if not len(at):
        return symbols, at, at
    # of the same sign many times in a row every other pair is merged, from the left
    runs = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    place = np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))
    at = at[place % 2 == 0]
    word = np.cumsum(symbols < 0) - (symbols < 0)
    touched = np.zeros(len(counts), bool)
    touched[word[at]] = True
    after = symbols.copy()
    after[at] = made[which[at]]
    gone = np.zeros(len(symbols), bool)
    gone[at + 1] = True
    after, word_after = after[~gone], word[~gone]
    changed, by_how_much = [], []
    for s, w, sign in ((symbols, word, -1), (after, word_after, 1)):
        here = np.flatnonzero(touched[w[:-1]] & (s[:-1] >= 0) & (s[1:] >= 0))
        changed.append((s[here].astype(np.int64) << 32) | s[here + 1])
        by_how_much.append(sign * counts[w[here]])
    return after, *_summed(np.concatenate(changed), np.concatenate(by_how_much))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their values, where those aren't zero."""
    if not len(keys):
        return keys, values
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.r_[True, np.diff(keys) != 0])
    sums = np.add.reduceat(values[by], first)
    return keys[first][sums != 0], sums[sums != 0]


_STATE = "symbols binary, counts binary, left int, right int, change long"


def _state(blocks: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, changes: np.ndarray) -> pa.RecordBatch:
    """Rows of words (symbols, counts) and rows of changes (left, right, change)."""
    n, m = len(blocks), len(keys)
    none = lambda k, kind: pa.nulls(k, kind)
    both = lambda head, tail: pa.concat_arrays([head, tail])
    words = [both(pa.array([b[i].tobytes() for b in blocks], pa.binary()), none(m, pa.binary())) for i in range(2)]
    pairs = [both(none(n, kind), pa.array(x, kind)) for x, kind in ((keys >> 32, pa.int32()), (keys & 0xFFFFFFFF, pa.int32()), (changes, pa.int64()))]
    return pa.RecordBatch.from_arrays([*words, *pairs], [c.split()[0] for c in _STATE.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (word, n) as symbols, with the counts of their pairs."""
    for b in batches:
        data = [w.encode("utf-8") for w in b.column(0).to_pylist()]
        symbols = np.full(sum(map(len, data)) + len(data), -1, np.int32)
        ends = np.cumsum([len(w) + 1 for w in data]) - 1
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(data), np.uint8)
        counts = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.cumsum(~inside) - ~inside
        at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        yield _state([(symbols, counts)], *_summed((symbols[at].astype(np.int64) << 32) | symbols[at + 1], counts[word[at]]))


def _learn_spread(words: DataFrame, merges: int, scratch: Scratch) -> list[tuple[bytes, bytes]]:
    """The same merges as learn() with the words left on the executors.

    The driver holds the counts of pairs alone. A round makes all merges that are certain without knowing what they change,
    in one pass over the words (blocks of numbers, gone through as arrays), which writes the words as they are then
    and, beside them, the changes of counts that each task has added up; only changes are shuffled and come to the driver.
    """
    pairs, learned, turn = Pairs(), [], 0
    state = scratch.table(words.select("word", "n").mapInArrow(_blocks, _STATE), "merged0")
    while True:
        changes = state.where("change is not null").groupBy("left", "right").agg(F.sum("change").alias("change")).where("change <> 0").toArrow()
        pairs.add(*(changes[c].to_pylist() for c in ("left", "right", "change")))
        batch = pairs.next(merges - len(learned))
        first = len(pairs.tokens) - len(batch)
        learned += [(pairs.tokens[a], pairs.tokens[b]) for a, b in batch]
        if not batch or len(learned) == merges:
            return learned
        numbered = [(a, b, first + k) for k, (a, b) in enumerate(batch)]

        def go(batches: Iterator[pa.RecordBatch], numbered=numbered) -> Iterator[pa.RecordBatch]:
            keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in batches:
                for symbols, counts in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                    counts = np.frombuffer(counts, np.int64)
                    after, k, v = _apply(np.frombuffer(symbols, np.int32), counts, numbered)
                    keys.append(k)
                    values.append(v)
                    yield _state([(after, counts)], keys[0], values[0])
            yield _state([], *_summed(np.concatenate(keys), np.concatenate(values)))

        turn += 1
        state = scratch.table(state.where("symbols is not null").mapInArrow(go, _STATE), f"merged{turn}")
        scratch.drop(f"merged{turn - 1}")


class _Words(dict):
    """Ids by word, made where they are missing."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> list[int]:
        self[word] = ids = self.make(word)
        return ids


#: The codecs that a worker has met last, by key, so that the next task finds the words that it knows.
_met: dict[str, "Codec"] = {}


def _codec(key: str, *parts) -> "Codec":
    if key not in _met:
        if len(_met) >= 2:
            _met.pop(next(iter(_met)))
        _met[key] = Codec(*parts)
        _met[key].key = key
    return _met[key]


class Codec:
    """Encodes and decodes with a vocabulary and merges; words are remembered up to a bound."""

    def __init__(self, vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]], specials: Iterable[str] = ()):
        import regex

        specials = tuple(specials)
        self.vocab = dict(vocab)
        self.specials = sorted(specials, key=len, reverse=True)
        tokens = set(self.vocab.values())
        for s in self.specials:
            if s.encode("utf-8") not in tokens:
                self.vocab[max(self.vocab, default=-1) + 1] = s.encode("utf-8")
        self.ids = {t: i for i, t in self.vocab.items()}
        self.rank = {p: k for k, p in enumerate(merges)}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.pattern = regex.compile(tx.PRETOKEN)
        self.special_ids = {s: self.ids[s.encode("utf-8")] for s in self.specials}
        self.known = _Words(self._make)
        self.parts, self.key = (vocab, merges, tuple(specials)), uuid.uuid4().hex

    def __reduce__(self):
        return _codec, (self.key, *self.parts)

    def word(self, word: str) -> list[int]:
        """Ids of a word; remembered, up to CACHE words."""
        return self.known[word]

    def _make(self, word: str) -> list[int]:
        symbols = [bytes([b]) for b in word.encode("utf-8")]
        while len(symbols) > 1:
            pair = min(zip(symbols, symbols[1:]), key=lambda p: self.rank.get(p, len(self.rank)))  # noqa: B905
            if pair not in self.rank:
                break
            symbols = merge(symbols, pair)
        return [self.ids[s] for s in symbols]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null."""
        out: list[int] = []
        for part in self.split.split(text or "") if self.split else [text or ""]:
            if part in self.special_ids:
                out.append(self.special_ids[part])
            else:
                out += chain.from_iterable(map(self.known.__getitem__, self.pattern.findall(part)))
        if len(self.known) >= CACHE:
            self.known.clear()
        return out

    def encode_iterable(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of chunks, each encoded for itself."""
        for chunk in chunks:
            yield from self.encode(chunk)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; unknown ids are left out, broken UTF-8 becomes U+FFFD."""
        return b"".join(self.vocab.get(i, b"") for i in ids).decode("utf-8", errors="replace")


def encoder(codec: Codec):
    """Column function: text to ids. A worker keeps the words that it has met from task to task, so nothing is shuffled."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(codec.encode)

    return encode


def decoder(codec: Codec):
    """Column function: ids to text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield ids.map(lambda x: codec.decode(() if x is None else x))

    return decode

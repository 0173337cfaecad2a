"""BPE merges learned in step by barrier tasks, each of which keeps its share of the words.

A round is two exchanges: all tasks tell by how much pairs have changed, and the first task tells the next merges. Nothing is
written or shuffled between rounds, so a round takes as long as its tasks look for the merged pairs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import pairwise
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

from millrace.operators import bpe

#: Bytes of words that one task holds where there are fewer than there are tasks for; symbols whose pairs are counted at once.
SHARE, PIECE = 2_000_000, 1 << 20
#: Pairs that the first task keeps for each merge that is asked for.
KEPT = 20


class Held:
    """Words as numbers, each word in a stretch of its own that it fills from the left; -1 after it."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        symbols, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for b in batches:
            data = b"".join([w.encode("utf-8") + b"\xff" for w in b.column(0).to_pylist()])  # a byte that UTF-8 never has
            symbols.append(np.frombuffer(data, np.uint8).astype(np.int32))
            counts.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        self.symbols, self.counts = np.concatenate(symbols), np.concatenate(counts)
        self.symbols[self.symbols == 255] = -1
        ends = np.flatnonzero(self.symbols < 0) + 1
        self.lengths = np.diff(ends, prepend=0)  # with the -1
        self.starts = ends - self.lengths
        self._close()

    def _close(self) -> None:
        """Words of one symbol go, and what others don't fill any more."""
        some = self.lengths > 2
        self.lengths, self.counts = self.lengths[some], self.counts[some]
        self.symbols = self.symbols[self._places(self.starts[some], self.lengths)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.filled = len(self.symbols)

    @staticmethod
    def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All places of stretches, one stretch after another."""
        return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

    @staticmethod
    def _pairs(symbols: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of adjacent pairs of closed-up words, and how often each counts."""
        here = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        return (symbols[here].astype(np.int64) << 32) | symbols[here + 1], times[here]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs, sorted, and their counts."""
        self._close()
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = sorted({0, *np.searchsorted(self.starts, np.arange(0, len(self.symbols), PIECE)).tolist(), len(self.starts)})
        for a, z in pairwise(cuts):
            part = self.symbols[self.starts[a] : self.starts[z - 1] + self.lengths[z - 1]]
            k, v = bpe._summed(*self._pairs(part, np.repeat(self.counts[a:z], self.lengths[a:z])))
            keys.append(k)
            values.append(v)
        return bpe._summed(np.concatenate(keys), np.concatenate(values))

    def apply(self, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Make the merges of a batch (left, right, made), no two of which meet at a symbol; returns the pairs whose counts change and
        by how much."""
        by = sorted((a << 32 | b, c) for a, b, c in batch)
        keys, made = (np.array(x, np.int64) for x in zip(*by, strict=True))
        left = np.zeros(int(made.max()) + 2, bool)  # -1 is the last
        left[keys >> 32] = True
        at = np.flatnonzero(left[self.symbols])
        pairs = (self.symbols[at].astype(np.int64) << 32) | self.symbols[at + 1]  # each word ends with -1
        which = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        met = keys[which] == pairs
        at, which = at[met], which[met]
        if not len(at):
            return at, at
        # of the same sign many times in a row every other pair is merged, from the left
        runs = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        turn = (np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))) % 2 == 0
        at, which = at[turn], which[turn]
        word = np.searchsorted(self.starts, at, "right") - 1
        words, first, merged = np.unique(word, return_index=True, return_counts=True)
        starts, lengths, times = self.starts[words], self.lengths[words], self.counts[words]
        places = self._places(starts, lengths)
        before = self.symbols[places]
        begins = np.cumsum(lengths) - lengths
        inside = at - np.repeat(starts - begins, merged)
        after = before.copy()
        after[inside] = made[which]
        stay = np.ones(len(after), bool)
        stay[inside + 1] = False
        after = after[stay]
        fewer = lengths - merged
        self.symbols[places] = -1
        self.symbols[self._places(starts, fewer)] = after
        self.lengths[words] = fewer
        self.filled -= len(at)
        gone, come = self._pairs(before, np.repeat(times, lengths)), self._pairs(after, np.repeat(times, fewer))
        if self.filled < 0.7 * len(self.symbols):
            self._close()
        return bpe._summed(np.concatenate([gone[0], come[0]]), np.concatenate([-gone[1], come[1]]))


class Group:
    """The tasks of a barrier stage, each connected with the first. Barriers themselves take a second each, so there is one."""

    def __init__(self, context: BarrierTaskContext, key: bytes):
        self.first, n = context.partitionId() == 0, len(context.getTaskInfos())
        listener = Listener(("", 0), "AF_INET", backlog=n, authkey=key) if self.first else None
        port = context.allGather(str(listener.address[1]) if listener else "-")[0]
        host = context.getTaskInfos()[0].address.rsplit(":", 1)[0]
        if listener:
            self.others = [listener.accept() for _ in range(n - 1)]
            listener.close()
        else:
            self.others = [Client((host, int(port)), "AF_INET", authkey=key)]

    def gather(self, *arrays: np.ndarray) -> list[list[np.ndarray]]:
        """What all tasks have, in the first; nothing in the others."""
        if self.first:
            return [list(arrays)] + [[np.frombuffer(c.recv_bytes(), "<i8") for _ in arrays] for c in self.others]
        for x in arrays:
            self.others[0].send_bytes(x.astype("<i8").tobytes())
        return []

    def tell(self, data: bytes) -> bytes:
        """What the first task has, in all."""
        if not self.first:
            return self.others[0].recv_bytes()
        for c in self.others:
            c.send_bytes(data)
        return data

    def close(self) -> None:
        for c in self.others:
            c.close()


def slots(spark: SparkSession) -> int:
    """Tasks that run at once for certain; 0 where barrier tasks can't."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    cores = spark.sparkContext.defaultParallelism
    if conf.contains("spark.default.parallelism"):  # then that says nothing about cores
        cores = int(conf.get("spark.executor.instances", "1")) * int(conf.get("spark.executor.cores", "1"))
    return cores // int(conf.get("spark.task.cpus", "1"))


def learn(words: DataFrame, merges: int, tasks: int, kept: int | None = None) -> list[tuple[bytes, bytes]]:
    """The merges that bpe.learn() finds in words (word, n), which are dealt out to so many tasks. kept: pairs that the first task
    may keep; the others are counted again when their turn comes."""
    kept = kept or max(100_000, KEPT * merges)

    secret = uuid.uuid4().bytes

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = Held(batches), Group(BarrierTaskContext.get(), secret)
        pairs = bpe.Pairs(kept) if group.first else None
        learned: list[tuple[bytes, bytes]] = []
        least, batch, end = 1, [], False
        while not end:
            if least:
                # what counts so much in all tasks counts a task's share of it in one at least
                keys, values = held.sums()
                told = group.gather(keys[values * tasks >= least])
                some = np.frombuffer(group.tell(np.unique(np.concatenate([x for (x,) in told])).tobytes() if told else b""), np.int64)
                mine = np.zeros(len(some), np.int64)
                at = np.searchsorted(keys, some)
                here = np.flatnonzero(at < len(keys))
                here = here[keys[at[here]] == some[here]]
                mine[here] = values[at[here]]
                told = group.gather(mine)
                if pairs:
                    pairs.begin(some, sum(x for (x,) in told), least)
            else:
                told = group.gather(*held.apply(batch))
                if pairs:
                    pairs.change(*bpe._summed(*map(np.concatenate, zip(*told, strict=True))))
            say = b""
            if pairs:
                found = pairs.next(merges - len(learned))
                first = len(pairs.tokens) - len(found)
                learned += [(pairs.tokens[a], pairs.tokens[b]) for a, b in found]
                again = 0 if found else pairs.floor // 4 or int(pairs.floor > 1)
                done = len(learned) == merges or not (found or again)
                say = json.dumps([again, [(a, b, first + k) for k, (a, b) in enumerate(found)], done]).encode()
            least, batch, end = json.loads(group.tell(say))
        group.close()
        if learned:
            lefts, rights = (pa.array(x, pa.binary()) for x in zip(*learned, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(learned)), pa.int32()), lefts, rights], ["rank", "left", "right"])

    rows = words.select("word", "n").repartition(tasks).mapInArrow(go, "rank int, left binary, right binary", barrier=True).collect()
    return [(bytes(r["left"]), bytes(r["right"])) for r in sorted(rows, key=lambda r: r["rank"])]

"""Bounded-space online packing of token ids into sequences.

Each partition is gone through once with a fixed number of open windows. A document's piece goes to the fullest
window that still holds it; where none does, the fullest window is filled up to the brim with the head of the piece
and emitted, and the tail goes on. At the end of a partition its open windows are merged the same way, which leaves
one that is not full. Those leftovers, one for each partition, are merged in groups, groups of groups, and so on; what
is left in the end is cut into sequences whose lengths are powers of two. So only full sequences and powers of two
come out, and nothing is padded.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, values
from .tokens import encoder

LENGTH = 2048
WINDOWS = 64
#: Leftovers that are merged in one task.
FAN_IN = 256

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: A piece: doc_id, start, ids (4 bytes each), tokens of the document.
Piece = tuple[int | None, int, bytes | memoryview, int]


class Packer:
    """Open windows of one partition. full: called with the pieces of each sequence that is full."""

    def __init__(self, full, length: int = LENGTH, windows: int = WINDOWS):
        self.full, self.length, self.most = full, length, windows
        self.rooms: list[tuple[int, int]] = []  # (room left, window), sorted: the fullest come first
        self.pieces: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, piece: Piece) -> None:
        doc_id, start, ids, total = piece
        ids, whole = memoryview(ids), 4 * self.length  # cuts don't copy what is left; what stays open is copied
        while len(ids) >= whole:
            self.full([(doc_id, start, ids[:whole], total)])
            start, ids = start + self.length, ids[whole:]
        while ids:
            need = len(ids) // 4
            at = bisect_left(self.rooms, (need, -1))
            if at < len(self.rooms):  # the fullest that holds it
                room, w = self.rooms.pop(at)
            elif len(self.rooms) < self.most:
                room, w, self.made = self.length, self.made, self.made + 1
                self.pieces[w] = []
            else:  # none holds it: fill the fullest
                room, w = self.rooms.pop(0)
                self.pieces[w].append((doc_id, start, bytes(ids[: 4 * room]), total))
                self.full(self.pieces.pop(w))
                start, ids = start + room, ids[4 * room :]
                continue
            self.pieces[w].append((doc_id, start, bytes(ids), total))
            if room == need:
                self.full(self.pieces.pop(w))
            else:
                insort(self.rooms, (room - need, w))
            return

    def leftover(self) -> list[Piece]:
        """Merge the open windows; what doesn't fill a sequence."""
        rest = [p for _, w in sorted(self.rooms) for p in self.pieces.pop(w)]
        self.rooms = []
        return merge(rest, self.full, self.length)


def merge(pieces: list[Piece], full, length: int) -> list[Piece]:
    """Fill sequences with pieces one after another; the pieces of the last, if it is not full."""
    now: list[Piece] = []
    room = length
    for doc_id, start, ids, total in pieces:
        while ids:
            n = min(room, len(ids) // 4)
            now.append((doc_id, start, ids[: 4 * n], total))
            start, ids, room = start + n, ids[4 * n :], room - n
            if not room:
                full(now)
                now, room = [], length
    return now


class Rows:
    """Gathers pieces as rows; sequence ids count up from base, leftovers get id -1 and keep their token ids."""

    def __init__(self, base: int, keep_ids: bool):
        self.next, self.keep, self.rows = base, keep_ids, []

    def full(self, pieces: list[Piece]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at, bytes(ids) if self.keep else None))
            at += n
        self.next += 1

    def left(self, pieces: list[Piece]) -> None:
        self.rows += [(d, s, len(i) // 4, 0, t, -1, k, i) for k, (d, s, i, t) in enumerate(pieces)]

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], schema=pa.schema(_FIELDS))


def _powers(pieces: list[Piece], full) -> None:
    """Cut a last, short sequence into sequences whose lengths are powers of two."""
    left = sum(len(p[2]) for p in pieces) // 4
    while left:
        size = 1 << (left.bit_length() - 1)
        head, room, rest = [], size, []
        for doc_id, start, ids, total in pieces:
            n = min(room, len(ids) // 4)
            if n:
                head.append((doc_id, start, ids[: 4 * n], total))
            if len(ids) > 4 * n:
                rest.append((doc_id, start + n, ids[4 * n :], total))
            room -= n
        full(head)
        pieces, left = rest, left - size


def _combine(level: int, last: bool, length: int, with_ids: bool):
    """Merge the leftovers of a group of partitions, or of a group of groups."""

    def combine(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        # these numbers lie above those of partitions and of levels below; groups of a level don't meet
        rows = Rows((level << 58) + (int(key[0]) << 30), with_ids)
        left = left.sort_values(["part", "offset"])
        doc_ids = [None if pd.isna(x) else int(x) for x in left["doc_id"]]
        ids = [bytes(x) for x in left["ids"]]
        rest = merge(list(zip(doc_ids, left["start"].tolist(), ids, left["doc_tokens"].tolist(), strict=True)), rows.full, length)
        if last:
            _powers(rest, rows.full)
        else:
            rows.left(rest)
        return rows.batch().to_pandas(integer_object_nulls=True).assign(part=int(key[0]))

    return combine


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, windows: int = WINDOWS, with_ids: bool = False) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of `length` tokens; one row for each piece of a document.

    Returns doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset (its
    place in the sequence) and, with_ids, its ids (four bytes each). A document's ids are its tokens and end_id; null and
    empty texts are end_id alone. Repeated rows are packed each for itself, null ids are kept. An empty table gives
    no piece.
    """
    scratch = Scratch(docs.sparkSession, "pack")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        rows = Rows(TaskContext.get().partitionId() << 33, with_ids)
        packer = Packer(rows.full, length, windows)
        for b in batches:
            for doc_id, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
                ids = memoryview(enc.encode(text) + end)
                # cut at whole sequences, which packs as the whole would
                for at in range(0, len(ids), 2000 * length):
                    packer.add((doc_id, at // 4, ids[at : at + 2000 * length], len(ids) // 4))
                    if len(rows.rows) >= 5_000:
                        yield rows.batch()
        rows.left(packer.leftover())
        enc.forget()
        yield rows.batch()

    packed = docs.select("doc_id", "text").mapInArrow(fill, SCHEMA).withColumn("part", F.spark_partition_id().cast("long"))
    packed = scratch.table(packed, "packed")
    out, open_ = packed.where("sequence_id >= 0"), packed.where("sequence_id < 0")
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        last = parts <= FAN_IN
        level += 1

        group = F.floor(F.col("part") / FAN_IN).alias("group")
        merged = scratch.table(open_.groupBy(group).applyInPandas(_combine(level, last, length, with_ids), SCHEMA + ", part long"), f"merged{level}")
        out = out.unionByName(merged.where("sequence_id >= 0"))
        if last:
            break
        open_, parts = merged.where("sequence_id < 0"), -(-parts // FAN_IN)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))

"""Flat token files: ids of two bytes each, the lower first, document after document, without anything between.

A file is written by many tasks, each at its own place, and shows under its name only when all are done. It is read in
ranges, so it may be of any size. In stores that can't be written at a place (all but local and mounted folders) it is a folder of
parts named by the id that they begin with; one after another they are the file.
"""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.ordering import free_names, sums_before
from millrace.scratch import Scratch
from millrace.session import small_batches
from millrace.sources.stores import Commit, files_of, store
from millrace.sources.tokens import MAX_ID

#: Bytes that are gathered before they are written, and ids of one row that is read.
PIECE, ROW = 8 << 20, 1 << 16


def write_flat(tokens: DataFrame, path: str) -> DataFrame:
    """Write tokens (doc_id, ids) in the order of doc_id to a flat file, in place of what is there; returns doc_id, start (ids
    before it), length of every row.

    Null ids count as none. Rows of one id are in the order of their ids' hashes; those without an id come first. An id outside
    0..65535 is an error, and then nothing shows.
    """
    spark = tokens.sparkSession
    scratch = Scratch(spark, "flat")
    data, start, n, key = free_names(4, tokens)
    rows = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias(data))
    rows = rows.withColumns({n: F.size(data).cast("long"), key: F.xxhash64(data)})
    placed = sums_before(scratch, rows, [F.col("doc_id").asc_nulls_first(), F.col(key).asc()], {start: F.col(n)}, "placed")
    placed = scratch.table(placed.select("doc_id", data, F.col(n).alias("length"), F.col(start).alias("start")), "starts")
    total = placed.agg(F.sum("length")).first()[0] or 0
    where, at = store(path)
    whole = _takes_places(where)
    hidden = f"{os.path.dirname(at)}/_temporary-{uuid.uuid4().hex}"
    commit = Commit(path, uuid.uuid4().hex)
    if whole:
        with open(hidden, "wb") as f:
            f.truncate(2 * total)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for begin, piece in _joined(batches):
            if whole:
                with open(hidden, "r+b") as f:
                    f.seek(2 * begin)
                    f.write(piece)
            else:
                names.append(f"{begin:020d}-{uuid.uuid4().hex}.bin")
                with commit.open(names[-1]) as out:
                    out.write(piece)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    try:
        with small_batches(spark):
            written = placed.select("start", data).mapInArrow(go, "name string").toArrow()["name"].to_pylist()
        if not whole:
            commit.finish(written, overwrite=True)
        else:
            os.replace(hidden, at)
    except BaseException:
        if whole:
            os.unlink(hidden)
        commit.drop()
        raise
    return placed.select("doc_id", "start", "length")


def _takes_places(where: fs.FileSystem) -> bool:
    """Whether a file can be written at any place."""
    return isinstance(where, fs.LocalFileSystem)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(first id's place, bytes) of rows (start, ids), those that follow one another put together."""
    begin, held = 0, bytearray()
    for b in batches:
        for at, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = ids.values.to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() > MAX_ID):
                raise ValueError(f"an id is outside 0..{MAX_ID}")
            if held and (at != begin + len(held) // 2 or len(held) >= PIECE):
                yield begin, bytes(held)
                held.clear()
            if not held:
                begin = at
            held += ids.astype("<u2").tobytes()
    if held:
        yield begin, bytes(held)


class Flat:
    """A flat file or folder of parts, for reading at places."""

    def __init__(self, path: str):
        self.where, _ = store(path)
        self.parts = files_of(path)
        ends = np.cumsum([n // 2 for _, n in self.parts]).tolist()
        self.begins, self.total = [0, *ends[:-1]], ends[-1] if ends else 0
        self.open: tuple[int, object] | None = None

    def read(self, start: int, length: int) -> bytes:
        """The bytes of so many ids from one on; fewer at the end."""
        out = []
        while length > 0 and start < self.total:
            k = bisect_right(self.begins, start) - 1
            if self.open is None or self.open[0] != k:
                if self.open is not None:
                    self.open[1].close()
                self.open = k, self.where.open_input_file(self.parts[k][0])
            n = min(length, self.parts[k][1] // 2 - (start - self.begins[k]))
            out.append(self.open[1].read_at(2 * n, 2 * (start - self.begins[k])))
            start, length = start + n, length - n
        return b"".join(out)


def slices(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose column n, of lengths, comes to PIECE in all, or which are a single row."""
    lengths = batch.column(n).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lengths):
        few = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 4096]), PIECE // 4, "right")))
        yield batch.slice(at, few)
        at += few


def read_at(places: DataFrame, path: str) -> DataFrame:
    """places (start, length, and any other columns) with ids: the ids of a flat file there, fewer where it ends.

    Places are dealt out in ranges of start, so that a task goes through a stretch of the file once.
    """
    (name,) = free_names(1, places)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema) + f", {name} array<int>"
    at, n = places.columns.index("start"), places.columns.index("length")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = Flat(path)
        for b in batches:
            for part in slices(b, n):
                ids = [np.frombuffer(file.read(s, m), "<u2").astype(np.int32) for s, m in zip(part.column(at).to_pylist(), part.column(n).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, name])

    return places.repartitionByRange("start").sortWithinPartitions("start").mapInArrow(go, schema).withColumnRenamed(name, "ids")


def read_flat(spark: SparkSession, path: str, row: int = ROW) -> DataFrame:
    """start, length, ids of a whole flat file, so many ids a row."""
    total = Flat(path).total
    starts = spark.range(0, total, row).select(F.col("id").alias("start"), F.least(F.lit(row), F.lit(total) - F.col("id")).alias("length"))
    return read_at(starts, path)


def drawn(seed: int, number: Column, room: int) -> Column:
    """A place from 0 to room - 1 that depends on the seed and a number alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string")).cast("binary")), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(room))


def random_windows(spark: SparkSession, path: str, length: int, batch: int, steps: int, seed: int, first_step: int = 0) -> DataFrame:
    """step, item, start, x, y: for each step a batch of windows of `length` ids anywhere in the stream, across documents as it
    comes; y is x moved on by one. A window depends on seed, step and item alone, so a run can go on from any step. A file of
    length ids or fewer has none."""
    room = Flat(path).total - length
    numbers = spark.range(first_step * batch, (first_step + steps) * batch if room > 0 else first_step * batch)
    start = drawn(seed, F.col("id"), max(room, 1))
    places = numbers.select(F.floor(F.col("id") / batch).alias("step"), F.pmod("id", F.lit(batch)).alias("item"), start.alias("start"), F.lit(length + 1).alias("length"))
    found = read_at(places, path)
    return found.select("step", "item", "start", F.slice("ids", 1, length).alias("x"), F.slice("ids", 2, length).alias("y"))


def shuffled(numbers: np.ndarray, room: int, key: int) -> np.ndarray:
    """A permutation of 0..room - 1 that depends on the key, at these places: four Feistel rounds over the next even number of bits,
    again and again while what comes out is outside."""
    half = max(1, -(-(room - 1).bit_length() // 2))
    mask, out = np.uint64((1 << half) - 1), numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            mixed = (right + np.uint64((key * 4 + turn + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(room)]
    return out.astype(np.int64)


def epoch_windows(spark: SparkSession, path: str, length: int, batch: int, seed: int, epoch: int = 0, first_step: int = 0, steps: int | None = None) -> DataFrame:
    """step, item, start, x, y: the windows at 0, length, 2 * length, .. of the stream, each once an epoch in an order that depends
    on seed and epoch; a run can go on from any step. The last batch may be smaller."""
    room = max(0, (Flat(path).total - 1) // length)
    end = room if steps is None else min(room, (first_step + steps) * batch)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = shuffled(b.column(0).to_numpy(), room, (seed << 20) + epoch)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at * length, pa.int64())], ["id", "start"])

    numbers = spark.range(min(first_step * batch, end), end).mapInArrow(go, "id long, start long")
    places = numbers.select(F.floor(F.col("id") / batch).alias("step"), F.pmod("id", F.lit(batch)).alias("item"), "start", F.lit(length + 1).alias("length"))
    found = read_at(places, path)
    return found.select("step", "item", "start", F.slice("ids", 1, length).alias("x"), F.slice("ids", 2, length).alias("y"))


def file_boundaries(path: str, chunks: int, delimiter: bytes, piece: int = 4096) -> list[int]:
    """Places at which a file may be cut into about so many chunks: even guesses, moved on to the next delimiter by reading
    from there, a piece at a time. Sorted and distinct, from 0 to the size."""
    where, _ = store(path)
    out = {0}
    for at, size in files_of(path)[:1]:
        out.add(size)
        with where.open_input_file(at) as file:
            for k in range(1, chunks):
                guess, held = k * (size // chunks), b""
                begin = guess
                while begin < size:
                    held = held[-(len(delimiter) - 1) :] * (len(delimiter) > 1) + file.read_at(piece, begin)
                    found = held.find(delimiter)
                    begin = min(size, begin + piece)
                    if found >= 0:
                        guess = begin - len(held) + found
                        break
                else:
                    guess = size
                out.add(guess)
    return sorted(out)


def file_chunks(spark: SparkSession, path: str, chunks: int, delimiter: bytes) -> DataFrame:
    """start, end, content (bytes) of a text file's chunks; each is read by the task that has it."""
    cuts = file_boundaries(path, chunks, delimiter)
    ranges = list(zip(cuts, cuts[1:], strict=False))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = store(path)
        with where.open_input_file(at) as file:
            for b in batches:
                for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([z]), pa.array([file.read_at(z - a, a)], pa.binary())], ["start", "end", "content"])

    rows = spark.createDataFrame(ranges, "start long, end long").repartition(max(1, len(ranges)), "start")
    return rows.mapInArrow(go, "start long, end long, content binary")

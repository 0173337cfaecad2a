"""Token ids in sorted-string-table files.

A shard holds the documents of a range of ids in ascending order. Layout of a file:

    block*   entries of about BLOCK_BYTES, as one zstd frame: for each entry the length of the prefix that its key
             shares with the key before (restarting at 0 in each block), the rest of the key, the value
    index    the first key, offset and length of every block
    filter   a Bloom filter over all keys
    footer   offsets of index and filter, counts, the width of an id, a magic number; FOOTER bytes at the end

Keys are ids as nine bytes whose order as bytes is that of the ids (null first). Values are ids of tokens, two bytes
each where all fit, else four. get() finds a document with one read of the footer, one binary search in the index
and one block; scan() goes through a shard in order.

Files are written under a temporary name and then moved, so that a task that runs twice leaves one good file.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, values
from .tokens import encoder

BLOCK_BYTES = 64 * 1024
BITS_A_KEY, PROBES = 10, 7
#: Documents in one shard, which are cut at quantiles of the id; and the most shards, since the driver keeps a list of
#: them: in larger tables shards hold more documents.
SHARD_ROWS, MAX_SHARDS = 8_192, 65_536
FOOTER = struct.Struct("<QQQQQII8s")
MAGIC = b"mrsstbl1"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(PROBES)]


class Writer:
    """Writes entries in the order they come, which must be that of their keys."""

    def __init__(self, out, wide: bool):
        self.out, self.width, self.at = out, 4 if wide else 2, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.entries = self.ids = 0
        self.block, self.size, self.first, self.before = [], 0, b"", b""
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        if not self.block:
            self.first, self.before = key, b""
        if key < self.before:
            raise ValueError("keys out of order")
        shared = next((i for i, (x, y) in enumerate(zip(key, self.before)) if x != y), min(len(key), len(self.before)))  # noqa: B905
        value = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block.append(struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.before = key
        self.hashes.append(key)
        self.entries, self.ids = self.entries + 1, self.ids + len(ids) // 4
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.index.append((self.first, self.at, len(data)))
            self.out.write(data)
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<BQQ", len(k), at, n) + k for k, at, n in self.index)
        bits = max(64, BITS_A_KEY * len(self.hashes))
        bloom = np.zeros(bits, bool)
        for k in self.hashes:
            bloom[_probes(k, bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), bits, self.entries, self.ids, self.width, 0, MAGIC))


class Reader:
    """Reads a shard; file: an open file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        head = self._at(size - FOOTER.size, FOOTER.size)
        self.index_at, self.bloom_at, self.bits, self.entries, self.ids, self.width, _, magic = FOOTER.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at = self._at(self.index_at, self.bloom_at - self.index_at), 0
        self.firsts, self.places = [], []
        while at < len(raw):
            n, where, length = struct.unpack_from("<BQQ", raw, at)
            self.firsts.append(raw[at + 17 : at + 17 + n])
            self.places.append((where, length))
            at += 17 + n
        self.bloom = np.frombuffer(self._at(self.bloom_at, (self.bits + 7) // 8), np.uint8)

    def _at(self, where: int, length: int) -> bytes:
        self.file.seek(where)
        return bytes(self.file.read(length))

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self._at(*self.places[k])), 0, b""
        while at < len(data):
            shared, rest, n = struct.unpack_from("<BBI", data, at)
            at += 6
            key = key[:shared] + data[at : at + rest]
            value = data[at + rest : at + rest + n]
            at += rest + n
            yield key, value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        """All entries in order: id, token ids as little-endian unsigned 32-bit integers."""
        for k in range(len(self.places)):
            for key, value in self._block(k):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[bytes]:
        """Token ids of the documents with this id: none, one, or more if the id repeats."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return []
        found, k = [], max(0, bisect_right(self.firsts, key) - 1)
        while k > 0 and self.firsts[k] == key:  # a repeated id may fill blocks
            k -= 1
        while k < len(self.places) and (self.firsts[k] <= key):
            found += [v for x, v in self._block(k) if x == key]
            k += 1
        return found


def open_input(uri: str):
    fs, path = _filesystem(uri)
    return fs.open_input_file(path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    """file:/x and /x as file:///x; other stores as they are."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return f"file://{path}" if path.startswith("/") else path


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write docs (doc_id, text) as shards and return their list: shard, path, entries, ids, in ascending order.

    A null or empty text is the end id alone. Repeated ids lie next to each other, in order of their texts within a
    file; a null id comes first. An id (or none) that more rows have than a shard shall hold fills several shards that
    hold nothing else, its rows dealt out evenly. An empty table gives no shard.
    """
    counts = docs.agg(F.count("*").alias("all"), F.count("doc_id").alias("named")).first()
    shard_rows = max(shard_rows, -(-counts["all"] // MAX_SHARDS))
    nameless = -(-(counts["all"] - counts["named"]) // shard_rows)
    n = max(1, -(-counts["named"] // shard_rows))
    cuts: list[int] = []
    if n > 1:
        # an id with very many rows is several quantiles
        steps = [i / n for i in range(1, n)]
        cuts = sorted(docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * n))).first()[0] or [])
    folder = _uri(scratch.path("shards"))
    n += nameless
    # a number for each shard whose hash sends it to a partition of its own
    shuffled = docs.sparkSession.range(int(n * (math.log(n) + 12))).select(F.col("id").cast("int").alias("key"))
    keys = shuffled.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("to")).agg(F.min("key").alias("key")).orderBy("to").toPandas()["key"]
    shared = docs.sparkSession.sparkContext.broadcast((np.array(cuts, np.int64), np.resize(keys.to_numpy(), n)))

    @F.pandas_udf("shard int, key int")
    def place(ids: pd.Series, row: pd.Series) -> pd.DataFrame:
        bounds, keys = shared.value
        none, row = ids.isna().to_numpy(), row.to_numpy()
        known = ids.fillna(0).astype("int64").to_numpy()
        low, high = (np.searchsorted(bounds, known, side=s) for s in ("left", "right"))
        # an id that is one cut begins the shard after it; one that is several has all but the last for itself
        alone = high - low > 1
        shard = nameless + np.where(alone, low + 1 + row % np.maximum(1, high - low - 1), high)
        shard = np.where(none, row % max(1, nameless), shard)
        return pd.DataFrame({"shard": shard.astype("int32"), "key": keys[shard]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        wide = max(enc.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        fs, root = _filesystem(folder)
        fs.create_dir(root)
        now, out, writer, temp, done = None, None, None, "", []

        def finish() -> None:
            writer.close()
            out.close()
            fs.move(temp, f"{root}/{now:08d}.sst")
            done.append((now, f"{folder}/{now:08d}.sst", writer.entries, writer.ids))

        for b in batches:
            for shard, doc_id, text in zip(*(values(b.column(i)) for i in range(3)), strict=True):
                if shard != now:
                    if writer:
                        finish()
                    now, temp = shard, f"{root}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                    writer = Writer(out, wide)
                writer.add(key_of(doc_id), enc.encode(text) + end)
        if writer:
            finish()
        enc.rest()
        names = ["shard", "path", "entries", "ids"]
        yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(names)}, pa.schema(list(zip(names, [pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True))))

    placed = docs.select(place("doc_id", F.monotonically_increasing_id()).alias("at"), "doc_id", "text").select("at.shard", "at.key", "doc_id", "text")
    ordered = placed.repartition(n, "key").select("shard", "doc_id", "text").sortWithinPartitions(F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return scratch.table(ordered.mapInArrow(write, "shard int, path string, entries long, ids long"), "list")


def read_shards(shards: DataFrame) -> DataFrame:
    """Go through the files of a list of shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    before, starts = 0, []
    for r in shards.orderBy("shard").collect():  # one row for each file, about MAX_SHARDS at most
        starts.append((r["path"], before))
        before += r["ids"]
    spark = shards.sparkSession
    files = spark.createDataFrame(starts, "path string, before long").repartition(max(1, len(starts)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with open_input(path) as f:
                    for doc_id, ids in Reader(f).scan():
                        rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Web archives (.warc and .wet files, plain or gzipped) as a data source.

A record ends where its Content-Length says, whatever its content looks like: bytes in a page that read like another
record are a part of the page. That can only be followed from a record's begin, so a file is split at begins of records that
are known: a first pass over large files (one task a file; it hops over contents and keeps one place for each share of the
file) finds them, and the scan then reads shares side by side. In gzipped files those are begins of members; a file
that is one member is read by one task.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from millrace.sources.stores import Commit, files_of, store

_GAP = b"\r\n\r\n"
# Fixed value: what a record begins with
_MAGIC = b"WARC/"
#: Bytes that are read or unzipped at once, and that a record's head may have at most.
PIECE, MAX_HEAD = 1 << 20, 1 << 20
#: Bytes of a file that one task reads.
SHARE = 128 << 20

SCHEMA = "url string, warc_type string, payload binary"
KINDS = ("response", "conversion")


class _Plain:
    """Bytes of a file from some place on, as far as they are asked for."""

    def __init__(self, file, start: int):
        self.file, self.base, self.buffer = file, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        data = self.file.read(PIECE)
        self.buffer += data
        return bool(data)

    def place(self) -> int | None:
        """Where a reader can begin to get what comes next; None if it can't begin here."""
        return self.base

    def drop(self, n: int) -> None:
        del self.buffer[:n]
        self.base += n

    def skip(self, n: int) -> None:
        if n > len(self.buffer):
            self.file.seek(self.base + n)
            self.buffer.clear()
            self.base += n
        else:
            self.drop(n)

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        self.drop(len(out))
        return out

    def find(self, marks: tuple[bytes, ...], most: int) -> tuple[int, int] | None:
        """(begin, length) of the first of marks that comes within the next `most` bytes."""
        seen, longest = 0, max(map(len, marks))
        while True:
            found = [(at, len(m)) for m in marks if (at := self.buffer.find(m, max(0, seen - longest))) >= 0]
            if found:
                return min(found)
            seen = len(self.buffer)
            if seen >= most or not self.more():
                return None


class _Gzip(_Plain):
    """The unzipped bytes of a gzipped file, from the begin of a member on. Places are begins of members."""

    def __init__(self, file, start: int):
        super().__init__(file, start)
        self.base, self.end, self.offset = 0, 0, start
        self.begins: dict[int, int] = {}
        self.raw, self.zip = b"", None

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(PIECE)
                if not self.raw:
                    return False
            if self.zip is None:
                self.raw, padding = self.raw.lstrip(b"\0"), len(self.raw)
                self.offset += padding - len(self.raw)
                if not self.raw:
                    continue
                self.zip = zlib.decompressobj(31)
                self.begins[self.end] = self.offset
            before = len(self.raw)
            data = self.zip.decompress(self.raw, PIECE)
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            self.offset += before - len(self.raw)
            if self.zip.eof:
                self.zip = None
            if data:
                self.buffer += data
                self.end += len(data)
                return True

    def place(self) -> int | None:
        return self.begins.get(self.base)

    def drop(self, n: int) -> None:
        super().drop(n)
        self.begins = {at: raw for at, raw in self.begins.items() if at >= self.base}

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.drop(len(self.buffer))
            if not self.more():
                return
        self.drop(n)


def _fields(head: bytes) -> dict[str, str]:
    """A head's named fields, names in lower case; of several of one name the first."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def frames(stream: _Plain, end: int | None, wanted) -> Iterator[tuple[int | None, dict[str, str], bytes | None]]:
    """(place, fields, content) of the records that begin before `end`; content is None where wanted(fields) is false.

    A record without a Content-Length goes on to what looks like the next one, and what is no record is passed over
    likewise. The last record may be cut off.
    """
    while True:
        while stream.buffer or stream.more():
            blank = len(stream.buffer) - len(stream.buffer.lstrip(b"\r\n"))
            stream.drop(blank)
            if stream.buffer:
                break
        else:
            return
        place = stream.place()
        if end is not None and place is not None and place >= end:
            return
        while len(stream.buffer) < len(_MAGIC) and stream.more():
            pass
        fields = {}
        if stream.buffer.startswith(_MAGIC):
            gap = stream.find((_GAP, b"\n\n"), MAX_HEAD) or (min(len(stream.buffer), MAX_HEAD), 0)
            fields = _fields(stream.take(gap[0]))
            stream.drop(gap[1])
        length = fields.get("content-length", "")
        if not length.isdecimal():
            content, mark, more = [], b"\n" + _MAGIC, True
            while more:
                found = stream.find((mark,), PIECE)
                more = found is None and len(stream.buffer) >= PIECE
                part = stream.take(found[0] + 1 if found else len(stream.buffer) - (len(mark) if more else 0))
                if fields and wanted(fields):
                    content.append(part)
            if fields:
                yield place, fields, b"".join(content).rstrip(b"\r\n") if wanted(fields) else None
        elif wanted(fields):
            yield place, fields, stream.take(int(length))
        else:
            stream.skip(int(length))
            yield place, fields, None


def body(kind: str, content: bytes) -> bytes:
    """A response without its HTTP head; other contents as they are."""
    if kind == "response":
        for gap in (_GAP, b"\n\n"):
            _, found, rest = content.partition(gap)
            if found:
                return rest
    return content


@dataclass
class Shares(InputPartition):
    """(path, size, begin, end) of parts of files; end is None for the rest of the file."""

    parts: list[tuple[str, int, int | None]]


def _stream(file, path: str, start: int) -> _Plain:
    file.seek(0)
    zipped = file.read(2) == b"\x1f\x8b"
    return (_Gzip if zipped else _Plain)(file, start)


class WarcReader(DataSourceReader):
    """options: path; kinds; most (records of each task); places (path and begin of shares, one a line); index (give the
    places of records instead, at most one for each share)."""

    def __init__(self, options):
        self.path = options["path"]
        self.kinds = set(options.get("kinds", ",".join(KINDS)).split(","))
        self.most = int(options["most"]) if "most" in options else None
        self.share = int(options.get("share", SHARE))
        self.index = options.get("index") == "true"
        self.places = [line.rpartition("\t")[::2] for line in options.get("places", "").split("\n") if line]

    def partitions(self):
        begins: dict[str, list[int]] = {}
        for path, at in self.places:
            begins.setdefault(path, []).append(int(at))
        out, now, size = [], [], 0
        for path, n in files_of(self.path):
            if self.index and n <= self.share:
                continue
            cuts = [0, *sorted(x for x in begins.get(path, []) if x > 0)]
            for a, b in zip(cuts, [*cuts[1:], None], strict=True):
                part = (b if b is not None else n) - a
                if now and size + part > self.share:
                    out.append(Shares(now))
                    now, size = [], 0
                now.append((path, a, b))
                size += part
        return [*out, *([Shares(now)] if now else [])]

    def read(self, partition: Shares | None) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        left = self.most
        for path, begin, end in partition.parts if partition else ():
            with where.open_input_file(path) as file:
                found = self._places(path, frames(_stream(file, path, begin), None, lambda f: False)) if self.index else self._records(frames(_stream(file, path, begin), end, self._wanted), left)
                for batch in found:
                    if left is not None:
                        left -= batch.num_rows
                    yield batch
            if left is not None and left <= 0:
                return

    def _wanted(self, fields: dict[str, str]) -> bool:
        return fields.get("warc-type", "").lower() in self.kinds

    def _records(self, found, most: int | None) -> Iterator[pa.RecordBatch]:
        return _batches(((f.get("warc-target-uri") or None, f["warc-type"].lower(), c) for _, f, c in found if c is not None), most)

    def _places(self, path: str, found) -> Iterator[pa.RecordBatch]:
        """Of the records at which a reader can begin, the first of each share."""
        due, rows = self.share, []
        for at, _, _ in found:
            if at is not None and at >= due:
                rows.append((path, at))
                due = (at // self.share + 1) * self.share
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "begin"])


def _batches(rows: Iterator[tuple[str | None, str, bytes]], most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (url, kind, content) as batches of some 4 MB."""
    kept, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*kept, strict=True)) or [()] * 3
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], ["url", "warc_type", "payload"])

    for n, (url, kind, content) in enumerate(rows, 1):
        kept.append((url, kind, body(kind, content)))
        size += len(content)
        if size >= 4 << 20 or n == most:
            yield batch()
            size = 0
        if n == most:
            return
    if kept:
        yield batch()


class PushingReader(WarcReader):
    """Takes conditions on warc_type into the scan. For sessions with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("warc_type",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("warc_type",):
                self.kinds &= set(f.value)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """Rows (url, warc_type, payload) as records, each a gzip member of its own; one file for each task."""

    def __init__(self, options, overwrite: bool):
        self.zipped, self.overwrite = options.get("compression", "gzip") == "gzip", overwrite
        self.commit_ = Commit(options["path"], uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.zipped else "")
        with self.commit_.open(name) as out:
            for b in iterator:
                for url, kind, payload in zip(*(b.column(c) for c in ("url", "warc_type", "payload")), strict=True):
                    record = as_record(url.as_py(), kind.as_py() or "", payload.as_py() or b"")
                    out.write(gzip.compress(record, 6, mtime=0) if self.zipped else record)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        self.commit_.finish([m.name for m in messages if m], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self.commit_.drop()


def as_record(url: str | None, kind: str, payload: bytes) -> bytes:
    """A record; a response gets a plain HTTP head."""
    content = (b"HTTP/1.1 200 OK\r\n\r\n" if kind == "response" else b"") + payload
    # an address or a kind that holds a line end would end its line
    line = lambda x: "".join((x or "").splitlines())
    head = f"WARC/1.0\r\nWARC-Type: {line(kind)}\r\nWARC-Target-URI: {line(url)}\r\nContent-Length: {len(content)}\r\n\r\n"
    return head.encode("utf-8", "replace") + content + _GAP


class WarcSource(DataSource):
    """spark.read.format("warc"), once registered."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "path string, begin long" if self.options.get("index") == "true" else SCHEMA

    def reader(self, schema) -> WarcReader:
        return (PushingReader if self.options.get("pushdown") == "true" else WarcReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def _options(spark: SparkSession, path: str, share: int) -> dict[str, str]:
    spark.dataSource.register(WarcSource)
    return {"path": path, "share": str(share), "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}


def places(spark: SparkSession, path: str, share: int = SHARE) -> DataFrame:
    """path, begin: places at which readers of large files can begin, at most one for each share of a file. May be kept as a
    table and given to read_warc()."""
    return spark.read.format("warc").options(**_options(spark, path, share), index="true").load()


def read_warc(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("response",), most: int | None = None, index: DataFrame | None = None, share: int = SHARE) -> DataFrame:
    """url, warc_type, payload of the records of the given kinds ("response" of .warc, "conversion" of .wet files).

    path: a file or a folder. The content of a response is its body, without the HTTP head. A missing url is null; a record
    without a Content-Length goes on to the next record; a record that is cut off has what is left of it. most: stop after so many
    records; no task reads further than that takes. index: places() of the path; found here if it isn't given and any file is
    larger than a share. From stores that only Spark can read, files are read whole, of 2 GB at most.
    """
    try:
        large = any(n > share for _, n in files_of(path))
    except ValueError:
        found = _whole_files(spark, path, kinds)
        return found if most is None else found.limit(most)
    options = _options(spark, path, share) | {"kinds": ",".join(kinds)}
    if large:
        # a row for each share of a file: as many as there will be tasks
        begins = (places(spark, path, share) if index is None else index).collect()
        options["places"] = "\n".join(f"{r['path']}\t{r['begin']}" for r in begins)
    if most is not None:
        options["most"] = str(most)
    found = spark.read.format("warc").options(**options).load()
    return found if most is None else found.limit(most)


class _Memory:
    """Bytes as a file."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        self.at += n
        return bytes(self.data[self.at - n : self.at])


def _whole_files(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                reader = WarcReader({"path": "", "kinds": ",".join(kinds)})
                yield from reader._records(frames(_stream(_Memory(data.as_py()), "", 0), None, reader._wanted), None)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(go, SCHEMA)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """records (url, warc_type, payload) as archive files, in place of what is there; a response gets a plain HTTP head. With
    gzip every record is a member of its own, so that files can be split. compression: gzip or none."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    rows = records.select(F.col("url"), "warc_type", "payload")
    rows.write.format("warc").option("compression", compression).mode("overwrite").save(path)

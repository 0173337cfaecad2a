"""Queries on flat token files, windows over a whole stream, draws by group, fingerprints of tables, code pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import charset, multiset
from millrace.operators import windows
from millrace.scratch import Scratch
from millrace.session import spread, table
from millrace.sources import flat

#: After the bytes of a document, which are its ids here.
END = 256
LENGTH, BATCH, STEPS, SEED = 64, 32, 40, 7
DRAWS = 20
PAGES = ("cp1252", "mac_roman", "utf-16-le")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def byte_ids(docs: DataFrame) -> DataFrame:
    """doc_id, ids: the bytes of a text and END; END alone for null. One part of a batch of texts is made ids at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in flat.slices(b, 2):
                ids = [np.r_[np.frombuffer((t.as_py() or "").encode("utf-8"), np.uint8).astype(np.int32), np.int32(END)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(go, "doc_id long, ids array<int>")


def _stream(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A flat file of all documents, and where each is."""
    path = Scratch(spark, "stream").path("tokens.bin")
    placed = flat.write_flat(byte_ids(_docs(spark, d)), _made(path))
    return path, placed


def _made(path: str) -> str:
    """path, whose folder is there."""
    where, at = flat.store(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    return path


def _md5(ids: str):
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"))


def flat_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every document as it stands in the flat file."""
    path, placed = _stream(spark, d)
    return flat.read_at(placed, path).select("doc_id", "start", "length", _md5("ids").alias("ids_md5"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Batches of windows anywhere in the stream of all documents."""
    path, _ = _stream(spark, d)
    found = flat.random_windows(spark, path, LENGTH, BATCH, STEPS, SEED)
    return found.select("step", "item", "start", _md5("x").alias("x_md5"), _md5("y").alias("y_md5"))


def epoch_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of an epoch, each of which comes once."""
    path, _ = _stream(spark, d)
    found = flat.epoch_windows(spark, path, 4 * LENGTH, BATCH, SEED)
    return found.select("start", _md5("x").alias("x_md5"), _md5("y").alias("y_md5"))


def group_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws from the words of each language, as often as they occur."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    counted = _docs(spark, d).where("lang is not null").select("lang", F.explode(words).alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    weighted = counted.select(F.col("lang").alias("group"), F.md5(F.encode("item", "UTF-8")).alias("item"), F.col("n").cast("double").alias("weight"))
    return windows.draws(weighted, DRAWS, SEED).select(F.col("group").alias("lang"), F.col("draw").cast("long").alias("draw"), F.col("item").alias("item_md5"))


def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of the documents of each source."""
    found = _docs(spark, d).groupBy("source").agg(multiset.fingerprint([F.col(c) for c in ("doc_id", "text", "lang")]).alias("f"))
    return found.select("source", "f.n", "f.a", "f.b")


def charset_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Documents put into each of some code pages and read again without being told which: how many, and whether 95 of 100 or
    more come back as they were."""

    def again(page: str):
        @F.pandas_udf("boolean")
        def same(texts: pd.Series) -> pd.Series:
            data = [t.encode(page) for t in texts]
            return pd.Series([b.decode(charset.detect(b), "replace") == t for b, t in zip(data, texts, strict=True)], dtype=bool)

        return same

    docs = _docs(spark, d).where("text is not null").select(*[again(p)("text").alias(p.replace("-", "_")) for p in PAGES])
    names = F.explode(F.array(*[F.struct(F.lit(p).alias("page"), F.col(p.replace("-", "_")).alias("same")) for p in PAGES])).alias("r")
    return docs.select(names).groupBy("r.page").agg(F.count("*").alias("n"), (F.avg(F.col("r.same").cast("double")) >= 0.95).alias("enough"))


QUERIES = {f.__name__: f for f in (flat_tokens, stream_windows, epoch_windows, group_draws, table_fingerprint, charset_accuracy)}

# one document's ids as two hexadecimal digits each, so that a place in the stream is a place in a string; the end is written ZZ
_STREAM = "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) || 'ZZ' AS h FROM documents), p AS (SELECT doc_id, h, coalesce(sum(length(h)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 2 AS start FROM h), s AS MATERIALIZED (SELECT string_agg(h, '' ORDER BY doc_id) AS s FROM h)"


def _ids(hexed: str) -> str:
    """md5 of the ids, in decimal, of a stretch of the stream."""
    return f"md5(array_to_string(list_transform(regexp_extract_all({hexed}, '..'), lambda x: CASE WHEN x = 'ZZ' THEN {END} ELSE ('0x' || x)::INTEGER END), ' '))"


def _number(salt: str) -> str:
    text = ", ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "text", "lang"))
    return f"(sum(('0x' || substr(md5('{salt}' || concat_ws(',', {text})), 1, 15))::BIGINT::HUGEINT) % {multiset.MODULUS})::BIGINT"


SQL = {
    "flat_tokens": _STREAM + f" SELECT doc_id, start, length(h) // 2 AS length, {_ids('h')} AS ids_md5 FROM p",
    "stream_windows": _STREAM
    + f", k AS (SELECT k, ('0x' || substr(md5('{SEED}:' || k::VARCHAR), 1, 12))::BIGINT % ((SELECT length(s) // 2 FROM s) - {LENGTH}) AS start FROM range({BATCH * STEPS}) t(k)),"
    + f" w AS (SELECT k, start, substr(s, (2 * start + 1)::BIGINT, {2 * LENGTH + 2}) AS w FROM k, s)"
    + f" SELECT k // {BATCH} AS step, k % {BATCH} AS item, start, {_ids(f'substr(w, 1, {2 * LENGTH})')} AS x_md5, {_ids('substr(w, 3)')} AS y_md5 FROM w",
    "epoch_windows": _STREAM
    + f", w AS (SELECT start, substr(s, (2 * start + 1)::BIGINT, {8 * LENGTH + 2}) AS w FROM s, (SELECT range AS start FROM range(0, (SELECT length(s) // 2 - 1 - {4 * LENGTH} + 1 FROM s), {4 * LENGTH})))"
    + f" SELECT start, {_ids(f'substr(w, 1, {8 * LENGTH})')} AS x_md5, {_ids('substr(w, 3)')} AS y_md5 FROM w",
    "group_draws": rf"""WITH c AS (SELECT lang, md5(item) AS item, count(*) AS n FROM (SELECT lang, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS item FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
r AS (SELECT lang, item, draw, -ln((('0x' || substr(md5('{SEED}:' || draw::VARCHAR || ':' || lang || ':' || item), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / n AS at_ FROM c, range({DRAWS}) t(draw))
SELECT lang, draw, arg_min(item, at_) AS item_md5 FROM r GROUP BY lang, draw""",
    "table_fingerprint": f"SELECT source, count(*) AS n, {_number('a')} AS a, {_number('b')} AS b FROM documents GROUP BY source",
    "charset_accuracy": f"SELECT page, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n, true AS enough FROM (VALUES {', '.join(f'({p!r})' for p in PAGES)}) t(page)",
}

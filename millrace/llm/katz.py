"""A Katz backoff model of word pairs, and the scores of texts under it.

P(w | v) = d(c) c(v w) / c(v) where the pair was seen in training, else alpha(v) P(w); P(w) = d(c) c(w) / N where the
word was seen, else what that leaves, which all unknown words share. d are Good-Turing discounts for counts up to K.
alpha(v) = (1 - sum of P(w | v) over the words seen after v) / (1 - sum of P(w) over the same words), so that every
distribution sums to 1 exactly. A word all of whose followers occur more than K times would leave nothing: there (and
for P likewise) one is added to the denominator. The end of a text is a token, and what comes before its first word.

How it is computed. Texts become chunks of token numbers that are local to the chunk, with the list of the chunk's
words. Words are counted over all chunks and numbered by falling count: the count of a number can then be told from
the list of distinct counts, which has no more than sqrt(2 N) entries and is broadcast. A chunk asks for each pair
once, in one packed row for each bucket of pairs. A bucket adds up its pairs over all chunks, keeps them as its part
of the model's tables, and answers every chunk in the order of its questions. With the answers each chunk scores its
texts, word for word. Words that follow very many others (they are few, whatever the corpus) have their pairs spread
over all buckets; all others have theirs in one. No pair is dropped, and a pair is sent once by a chunk, not once for
each time it occurs.

The order is two, and numbers of words have 32 bits: more than 2**32 - 2 distinct words are an error. Words are told
apart by 64-bit hashes, so two of some billions of distinct words may count as one. ngrams.py has neither bound, any
order, and models that are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_rank, values

#: Counts above K aren't discounted.
K = 5
#: Tokens of a chunk; tokens of all texts for each bucket.
CHUNK_TOKENS, BUCKET_TOKENS = 5 << 19, 7 << 19
#: Words beyond this share of the training tokens have their pairs spread: there are at most so many of them.
MAX_HOT = 4_096


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one type as one compressed block."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


CHUNKS = "chunk long, doc_ids array<long>, held binary, lengths binary, tokens binary, n_words long, words binary, counts binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, held, text) to chunks. words: XXH64 of each word, that of the empty word being the end's."""
    made = TaskContext.get().partitionId() << 24

    def chunk() -> pa.RecordBatch:
        nonlocal made
        lengths = np.array(sizes, "<u4")
        trained = np.concatenate([t for t, h in zip(parts, held, strict=True) if not h] or [np.zeros(0, np.uint32)])
        counts = np.bincount(trained, minlength=len(numbers)).astype("<u4")
        words = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        row = [made, doc_ids, np.array(held, bool).tobytes(), _pack(lengths), _pack(np.concatenate(parts)), len(words), words.tobytes(), counts.tobytes()]
        made += 1
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    def fresh() -> tuple:
        n = _Numbers()
        return n, n[b""], [], [], [], [], 0

    numbers, end, doc_ids, held, sizes, parts, total = fresh()
    for b in batches:
        for doc_id, h, text in zip(*(values(b.column(i)) for i in range(3)), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            words.append(b"")
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            doc_ids.append(doc_id)
            held.append(h)
            sizes.append(len(words))
            total += len(words)
            if total >= CHUNK_TOKENS:
                yield chunk()
                numbers, end, doc_ids, held, sizes, parts, total = fresh()
    if parts:
        yield chunk()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (chunk, words, counts) to one row for each of their words."""
    for b in batches:
        for chunk, words, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            word, n = np.frombuffer(words, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
            columns = [pa.array(word), pa.array(np.full(len(word), chunk)), pa.array(np.arange(len(word), dtype=np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "chunk", "pos", "n"])


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d(0..K+1), where the last stands for all counts above K, from n_0, n_1 .. n_(K+1).

    Good-Turing discounts in Katz's form; where a number is missing or a discount falls outside (0, 1), a half is
    taken off every count up to K instead.
    """
    n = counts_of_counts.astype(np.float64)
    r = np.arange(1, K + 1)
    d = np.ones(K + 2)
    d[1 : K + 1] = (r - 0.5) / r
    if (n[1:] > 0).all():
        cut = (K + 1) * n[K + 1] / n[1]
        if cut < 1:
            good = ((r + 1) * n[2:] / (r * n[1:-1]) - cut) / (1 - cut)
            if ((good > 0) & (good < 1)).all():
                d[1 : K + 1] = good
    return d


class Unigrams:
    """Probability of words by number. ends, values: the words with number below ends[i] (and not below ends[i - 1])
    occur values[i] times in training; values fall."""

    def __init__(self, values: np.ndarray, words: np.ndarray):
        self.values, self.ends = values.astype(np.int64), np.cumsum(words)
        self.total, self.known = int((values * words).sum()), int(words.sum())
        seen = np.zeros(K + 2)
        for v, w in zip(values, words, strict=True):
            if v <= K + 1:
                seen[v] = w
        d = discounts(seen)
        p = d[np.minimum(self.values, K + 1)] * self.values
        left = self.total - float((p * words).sum())
        over = self.total if left > 1e-9 * max(1, self.total) else self.total + 1
        self.p = np.append(p / max(1, over), (over - float((p * words).sum())) / over if over else 1.0)
        self.log_p = np.log10(self.p)

    def run(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, ids, side="right")

    def count(self, ids: np.ndarray) -> np.ndarray:
        return np.append(self.values, 0)[self.run(ids)]


def _bucket(history: np.ndarray, word: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    """Where a pair is counted: by its first word, or by both if the first has a number below hot."""
    x = history.astype(np.uint64) + np.where(history < hot, (word.astype(np.uint64) + np.uint64(1)) << np.uint64(32), np.uint64(0))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _pairs(tokens: np.ndarray, end: int, unknown: int, hot: int, buckets: int):
    """Distinct pairs of a chunk with a known first word, ordered by bucket: (keys, their order, bucket of each, where
    each token's pair is among all distinct pairs, all distinct pairs)."""
    history = np.concatenate([np.array([end], np.uint32), tokens[:-1]])
    keys = (history.astype(np.uint64) << np.uint64(32)) | tokens
    every, at = np.unique(keys, return_inverse=True)
    first, second = (every >> np.uint64(32)).astype(np.uint32), every.astype(np.uint32)
    asked = np.flatnonzero(first != unknown)
    bucket = _bucket(first[asked], second[asked], hot, buckets)
    order = np.argsort(bucket, kind="stable")
    return every, at, asked[order], bucket[order]


PARTS = "kind string, bucket int, chunk long, data binary"
_PARTS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS) if rows else _PARTS.empty_table()


def _ask(unknown: int, hot: int, buckets: int):
    """A chunk and the numbers of its words to its questions."""

    def go(chunks: pa.Table, numbers: pa.Table) -> pa.Table:
        rows = []
        for c in chunks.to_pylist():
            ids = np.full(c["n_words"], unknown, np.uint32)
            ids[numbers["pos"].to_numpy()] = numbers["id"].to_numpy()
            tokens = ids[_unpack(c["tokens"], "<u4")]
            train = np.repeat(~np.frombuffer(c["held"], bool), _unpack(c["lengths"], "<u4"))
            every, at, asked, bucket = _pairs(tokens, int(ids[0]), unknown, hot, buckets)
            n = np.bincount(at[train], minlength=len(every)).astype(np.uint32)[asked]
            first, second = (every[asked] >> np.uint64(32)).astype(np.uint32), every[asked].astype(np.uint32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                part = slice(edges[k], edges[k + 1])
                steps = np.diff(first[part], prepend=np.uint32(0))  # they rise within a bucket
                rows.append(("ask", int(k), c["chunk"], _pack(steps, second[part], n[part])))
            rows.append(("ids", None, c["chunk"], _pack(ids)))
        return _rows(rows)

    return go


def _answer(shared, hot: int):
    """All questions of a bucket to its answers and its part of the model."""

    def go(key: tuple, asks: pa.Table) -> pa.Table:
        bucket, unigrams = int(key[0].as_py()), shared.value
        chunks, parts = asks["chunk"].to_pylist(), []
        for data in asks["data"]:
            steps, second, n = _unpack(data.as_py(), "<u4").reshape(3, -1)
            parts.append((np.cumsum(steps, dtype=np.uint32), second, n))
        ends = np.cumsum([len(p[0]) for p in parts])
        first, second, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        every, at = np.unique((first.astype(np.uint64) << np.uint64(32)) | second, return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(every)).astype(np.int64)  # exact below 2**53
        del n
        head, tail = (every >> np.uint64(32)).astype(np.uint32), every.astype(np.uint32)
        seen = count > 0
        rows = [("grams", bucket, None, _pack(head[seen].astype("<i8"), tail[seen].astype("<i8"), count[seen]))]
        seen_n = np.bincount(np.minimum(count[seen], K + 2), minlength=K + 3)[: K + 2]
        rows.append(("counts", bucket, None, seen_n.astype("<i8").tobytes()))
        # of each first word: followers by count up to K, occurrences in greater counts, probability of followers
        names, where = np.unique(head, return_inverse=True)
        stats = np.zeros((K + 2, len(names)))
        small = seen & (count <= K)
        np.add.at(stats, (count[small] - 1, where[small]), 1)
        large = count > K
        stats[K] = np.bincount(where[large], weights=count[large], minlength=len(names))
        p = unigrams.p[unigrams.run(tail)]
        stats[K + 1] = np.bincount(where[seen], weights=p[seen], minlength=len(names))
        rows.append(("histories", bucket, None, _pack(names.astype("<f8"), stats)))
        full = stats[:K].sum(axis=0) == 0
        begin = 0
        for chunk, stop in zip(chunks, ends.tolist(), strict=True):
            mine = at[begin:stop]
            unseen = np.unique(where[mine[count[mine] == 0]])
            unseen = unseen[names[unseen] >= hot]
            named = np.unique(where[mine])
            named = named[(names[named] >= hot) & full[named]]
            back = [count[mine].astype("<u4").tobytes(), names[named].astype("<u4").tobytes(), names[unseen].astype("<f8").tobytes() + stats[:, unseen].astype("<f8").tobytes()]
            sizes = np.array([len(x) for x in back], "<u8").tobytes()
            rows.append(("answer", bucket, chunk, zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(back))))
            begin = stop
        return _rows(rows)

    return go


def alphas(stats: np.ndarray, count: np.ndarray, d: np.ndarray, least: float) -> np.ndarray:
    """Backoff weights of words from their rows of statistics and their counts in training."""
    r = np.arange(1, K + 1)
    kept = (stats[:K] * (d[1 : K + 1] * r)[:, None]).sum(axis=0) + stats[K]
    over = count + (stats[:K].sum(axis=0) == 0)
    return (1 - kept / over) / np.maximum(1 - stats[K + 1], least)


def _score(shared, hot: int, buckets: int):
    """A chunk and the answers it got to the scores of its texts."""

    def go(chunks: pa.Table, parts: pa.Table) -> pa.Table:
        unigrams, d, hot_ids, hot_alpha, hot_full = shared.value
        unknown, out = unigrams.known, []
        for c in chunks.to_pylist():
            ids, answers = None, {}
            for kind, bucket, data in zip(parts["kind"].to_pylist(), parts["bucket"].to_pylist(), parts["data"], strict=True):
                if kind == "ids":
                    ids = _unpack(data.as_py(), "<u4")
                else:
                    answers[bucket] = zstandard.ZstdDecompressor().decompress(data.as_py())
            tokens = ids[_unpack(c["tokens"], "<u4")]
            every, at, asked, bucket = _pairs(tokens, int(ids[0]), unknown, hot, buckets)
            count = np.zeros(len(every), np.int64)
            full, names, stats = [np.zeros(0, np.uint32)], [np.zeros(0)], [np.zeros((K + 2, 0))]
            got = []
            for k in np.unique(bucket):
                data = answers[int(k)]
                a, b, _ = np.frombuffer(data, "<u8", 3).astype(int)
                got.append(np.frombuffer(data, "<u4", a // 4, 24))
                full.append(np.frombuffer(data, "<u4", b // 4, 24 + a))
                rest = np.frombuffer(data, "<f8", offset=24 + a + b).reshape(K + 3, -1) if len(data) > 24 + a + b else np.zeros((K + 3, 0))
                names.append(rest[0])
                stats.append(rest[1:])
            if got:
                count[asked] = np.concatenate(got)
            first, second = (every >> np.uint64(32)).astype(np.uint32), every.astype(np.uint32)
            of_first = unigrams.count(first).astype(np.float64)
            over = of_first + np.isin(first, np.concatenate([*full, hot_ids[hot_full]]).astype(np.uint32))
            seen = count > 0
            logp = unigrams.log_p[unigrams.run(second)].copy()
            base = np.log10((unigrams.count(second) + 1) / (unigrams.total + unigrams.known + 1))
            logp[seen] = np.log10(d[np.minimum(count[seen], K + 1)] * count[seen] / over[seen])
            named = np.concatenate([*names, hot_ids]).astype(np.int64)
            weight = alphas(np.concatenate(stats, axis=1), unigrams.count(np.concatenate(names).astype(np.int64)).astype(np.float64), d, unigrams.p[-1])
            weight = np.log10(np.concatenate([weight, hot_alpha]))
            order = np.argsort(named)
            named, weight = named[order], weight[order]
            back = np.flatnonzero(~seen & (first != unknown))
            logp[back] += weight[np.searchsorted(named, first[back])]
            lengths = _unpack(c["lengths"], "<u4").astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            total = lambda x: np.add.reduceat(x[at], starts)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(c["doc_ids"], pa.int64()),
                        "held_out": pa.array(np.frombuffer(c["held"], bool)),
                        "n_tokens": pa.array(lengths),
                        "n_known": pa.array(total((second != unknown).astype(np.int64))),
                        "base_score": pa.array(total(base)),
                        "score": pa.array(total(logp)),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in _SCORES})

    return go


_SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _bucket_stats(rows: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Statistics of the words whose pairs lie in several buckets, by word."""
    for b in rows:
        for data in b.column(0):
            all_ = _unpack(data.as_py(), "<f8").reshape(K + 3, -1)
            some = all_[:, all_[0] < hot]
            yield pa.RecordBatch.from_pydict({"id": pa.array(some[0].astype(np.int64)), "stats": pa.array(list(some[1:].T), pa.list_(pa.float64()))})


class Katz:
    """A model and the scores of the texts it was made with.

    grams(): rows first, second, n of the model; histories and words are kept under `scratch`.
    """

    def __init__(self, scratch: Scratch, scores: DataFrame, unigrams: Unigrams, d: np.ndarray):
        self.scratch, self.scores, self.unigrams, self.discounts = scratch, scores, unigrams, d

    def grams(self) -> DataFrame:
        def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for data in b.column(0):
                    first, second, n = _unpack(data.as_py(), "<i8").reshape(3, -1)
                    yield pa.RecordBatch.from_pydict({"first": first, "second": second, "n": n})

        return self.scratch.spark.read.parquet(self.scratch.path("model")).where("kind = 'grams'").select("data").mapInArrow(go, "first long, second long, n long")

    def words(self) -> DataFrame:
        """word (XXH64 of its lower-cased UTF-8 as signed number; of nothing: the end), n, id."""
        return self.scratch.spark.read.parquet(self.scratch.path("words"))


def katz(docs: DataFrame) -> Katz:
    """Learn from and score docs (doc_id, text, held): rows with held true are scored but not learned from.

    scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row of docs. A
    text that is null or has no words is its end alone. Null ids are kept; a null held counts as false; repeated rows
    count each for itself. Without training texts every token has probability 1. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    held = F.coalesce(F.col("held"), F.lit(False)).alias("held")
    chunks = scratch.table(docs.select("doc_id", held, "text").mapInArrow(_chunks, CHUNKS), "chunks")

    words = chunks.select("chunk", "words", "counts").mapInArrow(_words, "word long, chunk long, pos int, n long")
    counted = scratch.table(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "counted")
    numbered = global_rank(scratch, counted, [F.col("n").desc(), F.col("word").asc()], "ranked", into="id")
    numbered = scratch.table(numbered, "words")
    scratch.drop("counted", "ranked")
    runs = numbered.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()  # at most sqrt(2 N) rows
    unigrams = Unigrams(runs["n"].to_numpy(np.int64), runs["words"].to_numpy(np.int64))
    if unigrams.known >= (1 << 32) - 1:
        raise ValueError("more words than 32 bits can number")
    tokens = lambda rows: (sum(int(_unpack(x.as_py(), "<u4").sum()) for x in b.column(0)) for b in rows)
    add_up = lambda rows: (pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())}) for n in tokens(rows))
    total = chunks.select("lengths").mapInArrow(add_up, "n long").agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_TOKENS))
    limit = max(BUCKET_TOKENS // 4, unigrams.total // MAX_HOT)
    hot = int(np.append(0, unigrams.ends)[int((unigrams.values > limit).sum())])

    # a word is asked for once by each chunk, so no word has more rows than there are chunks
    ids = words.join(numbered.select("word", "id"), "word").select("chunk", "pos", "id")
    asked = chunks.select("chunk", "held", "lengths", "tokens", "n_words").groupBy("chunk").cogroup(ids.groupBy("chunk"))
    asks = scratch.table(asked.applyInArrow(_ask(unigrams.known, hot, buckets), PARTS), "asks", ("kind",))
    known = spark.sparkContext.broadcast(unigrams)
    answered = asks.where("kind = 'ask'").select("bucket", "chunk", "data").groupBy("bucket").applyInArrow(_answer(known, hot), PARTS)
    scratch.release()  # what the shuffles of the questions left
    model = scratch.table(answered, "model", ("kind",))
    scratch.drop("asks/kind=ask")

    seen = np.zeros(K + 2, np.int64)
    for r in model.where("kind = 'counts'").select("data").toLocalIterator():  # seven numbers for each bucket
        seen += np.frombuffer(r["data"], "<i8")
    d = discounts(seen)
    shape = "id long, stats array<double>"
    parts = model.where("kind = 'histories'").select("data").mapInArrow(lambda rows: _bucket_stats(rows, hot), shape)
    summed = parts.groupBy("id").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 2)]).orderBy("id").toPandas()  # at most MAX_HOT rows
    hot_ids = summed["id"].to_numpy(np.int64)
    stats = summed[[f"s{i}" for i in range(K + 2)]].to_numpy(np.float64).T
    hot_alpha = alphas(stats, unigrams.count(hot_ids).astype(np.float64), d, unigrams.p[-1])
    known = spark.sparkContext.broadcast((unigrams, d, hot_ids, hot_alpha, stats[:K].sum(axis=0) == 0))

    asks = spark.read.schema(asks.schema).parquet(scratch.path("asks"))
    told = asks.where("kind = 'ids'").unionByName(model.where("kind = 'answer'")).select("kind", "bucket", "chunk", "data")
    scored = chunks.select("chunk", "doc_ids", "held", "lengths", "tokens").groupBy("chunk").cogroup(told.groupBy("chunk"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scores = scored.applyInArrow(_score(known, hot, buckets), schema)
    scores = scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.total).cast("long").alias("train_tokens"), "base_score", "score")
    return Katz(scratch, scores, unigrams, d)

"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, one row for each language and one column for each of BUCKETS hash values.
Its size is bounded by BUCKETS * MAX_LANGS numbers, so it is broadcast. A batch of texts is scored at once: the n-grams
of all its texts lie in one array of columns, with the place where each text begins, and a language's numbers are
taken for the whole array and added up by text.

The posterior of naive Bayes says which of the learned languages is the likeliest, and is close to 1 for any text of
some length, be it junk. So the score weighs it with how well the text fits the language at all: the mean log
probability of its n-grams is held against that of texts of the language which the model was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.ordering import free_names

from .common import uniform, values

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: The model is fitted on about so many whole texts of each language, and its fit measured on as many others, drawn by
#: a hash of id and text.
FIT_TEXTS = 1_500
#: Languages that are learned: those with the most texts.
MAX_LANGS = 400
#: Characters that are hashed at once.
PIECE = 1 << 18
UNKNOWN = "und"
#: Standard deviations below the language's mean at which a text's score is halved, and how fast it falls there.
FAR, STEEP = 6.0, 2.0


def _pieces(texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(text, characters, n-grams may begin before this place): texts in lower case with a space at both ends, long
    ones in pieces that overlap by what an n-gram needs."""
    for i, text in enumerate(texts):
        chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(chars), PIECE):
            yield i, chars[at : at + PIECE + max(ORDERS) - 1], min(PIECE, len(chars) - at)


def grams(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of the n-grams of texts as a sparse batch: (texts, where each begins, columns).

    Several arrays for each batch: one for each order, and no more than about PIECE characters in each. Where a place
    has no n-gram, since its text ends before, the column is BUCKETS.
    """
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def columns() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        chars = np.concatenate([c for _, c, _ in held])
        of = np.array([i for i, _, _ in held])
        ends = np.cumsum([len(c) for _, c, _ in held])
        starts = ends - [len(c) for _, c, _ in held]
        limits = starts + [n for _, _, n in held]
        h = np.zeros(len(chars), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = h * np.uint32(0x01000193)
            h[: len(chars) - n + 1] += chars[n - 1 :]
            if n in ORDERS:
                mixed = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                column = ((mixed >> np.uint32(16)) % np.uint32(BUCKETS)).astype(np.int32)
                for limit, end in zip(limits, ends, strict=True):
                    column[min(limit, max(end - n + 1, 0)) : end] = BUCKETS
                yield of, starts, column

    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size >= PIECE:
            yield from columns()
            held, size = [], 0
    if held:
        yield from columns()


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (langs, BUCKETS + 1); the last column is 0
    prior: np.ndarray
    mean: np.ndarray  # of the mean log probability of a text's n-grams, by language
    spread: np.ndarray  # its variance from text to text
    noise: np.ndarray  # the variance of one n-gram

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each text under each language, number of its n-grams)."""
        total, n = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts))
        for of, starts, column in grams(texts):
            for k, of_lang in enumerate(self.logp):
                np.add.at(total[k], of, np.add.reduceat(of_lang.take(column), starts, dtype=np.float64))
            np.add.at(n, of, np.add.reduceat(column < BUCKETS, starts, dtype=np.float64))
        return total, n

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the likeliest language, score) of each of a batch of texts."""
        total, n = self.sums(texts)
        joint = total + self.prior[:, None]
        best = joint.argmax(axis=0)
        at = np.arange(len(texts))
        posterior = 1 / np.exp(joint - joint[best, at]).sum(axis=0)
        off = (total[best, at] / n - self.mean[best]) / np.sqrt(self.spread[best] + self.noise[best] / n)
        return best, posterior / (1 + np.exp(np.minimum(-STEEP * (off + FAR), 700.0)))


def _by_lang(place: dict[str, int]):
    """Batches (lang, text) to the counts of each language's n-grams, sparse."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_text = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            seen: dict[int, np.ndarray] = {}
            for of, starts, column in grams(values(b.column(1))):
                lang = np.repeat(of_text[of], np.diff(np.append(starts, len(column))))
                for k in np.unique(of_text[of]).tolist():
                    found = np.bincount(column[lang == k], minlength=BUCKETS + 1)[:BUCKETS]
                    seen[k] = seen[k] + found if k in seen else found
            for k, n in seen.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "columns": [some.astype("<i4").tobytes()], "n": [n[some].astype("<i8").tobytes()]})

    return go


def _log_probabilities(alpha: float):
    """All counts of a language to its row of the matrix, its variance of one n-gram."""

    def go(t: pa.Table) -> pa.Table:
        n = np.full(BUCKETS, alpha)
        for columns, found in zip(t["columns"], t["n"], strict=True):
            n[np.frombuffer(columns.as_py(), "<i4")] += np.frombuffer(found.as_py(), "<i8")
        p = n / n.sum()
        logp = np.log(p).astype("<f4")
        noise = float((p * logp.astype(float) ** 2).sum() - (p * logp).sum() ** 2)
        return pa.table({"k": pa.array([t["k"][0].as_py()], pa.int32()), "logp": [logp.tobytes()], "noise": [noise]})

    return go


def fit(labelled: DataFrame, texts: int = FIT_TEXTS, alpha: float = 0.1) -> Model:
    """Fit on rows doc_id, text, lang. Rows without text or language aren't used.

    The MAX_LANGS languages with the most texts are learned (ties by name); texts of others aren't learned from. A
    language all of whose drawn texts serve the fit is measured on those.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    named = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    counts = {r["lang"]: r["n"] for r in named}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), *[np.zeros(0)] * 4)
    place = {x: i for i, x in enumerate(langs)}
    # half of those below the rate serve the fit
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 2 * texts / counts[k]))]), F.col("lang"))
    drawn = rows.select("lang", "text", uniform(F.lit(1), F.col("doc_id"), F.col("text")).alias("u"), rate.alias("rate")).where("u < rate")
    summed = drawn.where("2 * u < rate or u = 0").select("lang", "text").mapInArrow(_by_lang(place), "k int, columns binary, n binary")
    found = summed.groupBy("k").applyInArrow(_log_probabilities(alpha), "k int, logp binary, noise double").collect()  # a row a language
    logp = np.zeros((len(langs), BUCKETS + 1), np.float32)
    logp[:, :BUCKETS] = -np.log(BUCKETS)  # of a language of which no text was drawn
    prior, noise = np.full(len(langs), -np.inf), np.ones(len(langs))
    for r in found:
        logp[r["k"], :BUCKETS] = np.frombuffer(r["logp"], "<f4")
        prior[r["k"]], noise[r["k"]] = np.log(counts[langs[r["k"]]]), r["noise"]
    if not found:
        prior[:] = [np.log(counts[x]) for x in langs]
    plain = Model(langs, logp, prior - np.log(np.exp(prior).sum()), np.zeros(len(langs)), np.ones(len(langs)), noise)
    shared = rows.sparkSession.sparkContext.broadcast(plain)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                of = np.array([place[x] for x in part.column(0).to_pylist()], np.int64)
                total, n = model.sums(list(values(part.column(1))))
                mean = total[of, np.arange(len(of))] / n
                yield pa.RecordBatch.from_pydict({"k": of, "fitted": part.column(2), "mean": mean, "noise": model.noise[of] / n})

    # what one text's n-grams make it vary is taken off the variance; a text's n-grams aren't independent, hence the floor
    each = drawn.select("lang", "text", F.expr("2 * u < rate or u = 0").alias("fitted")).mapInArrow(measure, "k long, fitted boolean, mean double, noise double")
    stats = each.groupBy("k", "fitted").agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), F.var_pop("mean").alias("var"), F.avg("noise").alias("noise"))
    for r in sorted(stats.collect(), key=lambda r: not r["fitted"]):  # those of other texts come last, and win
        if r["fitted"] or r["n"] >= 8:
            plain.mean[r["k"]] = r["mean"]
            plain.spread[r["k"]] = max(r["var"] - r["noise"], 0.01)
    return plain


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text).

    The score is the posterior of the likeliest language times a factor near 1 for texts whose n-grams are about as
    likely as those of other texts of the language, a half at FAR standard deviations below, and near 0 beyond. A text
    that is null or holds no letter is `und` with score 0; so is every text if nothing could be learned. Ties go to
    the language that comes first by name. Rows are judged each for itself.
    """
    found, (lang, score) = judge_rows(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def judge_rows(docs: DataFrame, model: Model) -> tuple[DataFrame, tuple[str, str]]:
    """docs (all columns) with language and score as identify() has them, and the names of those two columns, which
    are none of docs'."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = shared.value
        for text, known in batches:
            lang, score = [UNKNOWN] * len(text), np.zeros(len(text))
            some = np.flatnonzero(known.to_numpy(zero_copy_only=False)) if model.langs else np.zeros(0, int)
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                best, score[part] = model.predict([text[int(i)].as_py() for i in part])
                for i, k in zip(part.tolist(), best.tolist(), strict=True):
                    lang[i] = model.langs[k]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    both, lang, score = free_names(3, docs)
    found = docs.withColumn(both, judge(docs["text"], has_letter(docs["text"])))
    return found.withColumns({lang: F.col(both)["lang"], score: F.col(both)["score"]}).drop(both), (lang, score)

"""Classifiers on whole texts. Each gives a struct (label, score)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import let

FEATURES = 1 << 14
# Words that the lexicon scorer counts
NSFW_WORDS = ("porn", "xxx", "nude", "naked", "sex", "erotic", "hardcore", "nsfw", "fetish", "orgasm", "cock", "dick", "pussy", "tits", "cum", "fuck", "fucking", "blowjob", "anal", "milf")
CJK_SHARE = 0.2
#: Languages that are written with Chinese characters.
HAN_LANGUAGES = ("zh", "ja", "yue", "wuu", "lzh")


def character_grams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the lower-cased text."""

    def grams(signs: Column) -> Column:
        last = F.greatest(F.size(signs) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(signs, i, n), ""))

    return let(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), grams)


def word_grams(text: Column) -> Column:
    """Words and pairs of words, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


@dataclass
class Classifier:
    """A fitted pipeline and the names of its classes; without a model (nothing to learn from) it names nothing."""

    model: PipelineModel | None
    labels: list[str]

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (.., grams) with label and score; null and 0 without a model."""
        if self.model is None:
            return rows.withColumns({"label": F.lit(None).cast("string"), "score": F.lit(0.0)})
        names = F.array(*[F.lit(x) for x in self.labels])
        label = F.element_at(names, F.col("prediction").cast("int") + 1)
        return self.model.transform(rows).withColumns({"label": label, "score": F.array_max(vector_to_array("probability"))})

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the classifier to a folder."""
        rows = [(k, x, self.model is not None) for k, x in enumerate(self.labels)] or [(-1, "", False)]
        spark.createDataFrame(rows, "k int, label string, learned boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Classifier":
        rows = spark.read.parquet(f"{path}/labels").orderBy("k").collect()
        return cls(PipelineModel.load(f"{path}/model") if rows[0]["learned"] else None, [r["label"] for r in rows if r["k"] >= 0])


def _sample(known: DataFrame, rows: int) -> DataFrame:
    """About so many of the rows, drawn by a hash of id and text."""
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)


def fit_language(labelled: DataFrame, fit_rows: int = 2_000) -> Classifier:
    """Naive Bayes on hashed character 3-grams, fitted on about fit_rows of the labelled texts (doc_id, text, lang)."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = _sample(known, fit_rows).select("lang", character_grams(F.col("text")).alias("grams"))
    if not grams.limit(1).count():
        return Classifier(None, [])
    indexer = StringIndexer(inputCol="lang", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(grams)
    steps = [HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="x"), NaiveBayes(featuresCol="x", labelCol="y")]
    return Classifier(Pipeline(stages=steps).fit(indexer.transform(grams)), list(indexer.labels))


def language(docs: DataFrame, labelled: DataFrame | None = None, fit_rows: int = 2_000, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, label, score of every row of docs, by a classifier or by one that is fitted on labelled.

    Where no language was learned that is written with Chinese characters, texts of which a fifth or more of the letters are
    such are zh, or ja if there are kana among them. Null texts count as empty, ids may be null or repeat. Where there was nothing
    to learn from, the label is null.
    """
    classifier = classifier or fit_language(labelled, fit_rows)
    text = F.coalesce("text", F.lit(""))
    learned = bool(set(HAN_LANGUAGES) & {x.lower().replace("_", "-").split("-")[0] for x in classifier.labels})
    letters, chinese = (F.length(F.regexp_replace(text, signs, "")) for signs in (r"[^\p{L}]", r"[^\p{IsHan}]"))
    share = F.coalesce(chinese / F.nullif(letters, F.lit(0)), F.lit(0.0))
    kana = F.regexp_like(text, F.lit(r"[\p{IsHiragana}\p{IsKatakana}]"))
    found = classifier.scored(docs.select("doc_id", character_grams(F.col("text")).alias("grams"), share.alias("han"), kana.alias("kana")))
    by_signs = F.lit(not learned) & (F.col("han") >= CJK_SHARE)
    label = F.when(by_signs, F.when(F.col("kana"), "ja").otherwise("zh")).otherwise(F.col("label"))
    return found.select("doc_id", label.alias("label"), F.when(by_signs, F.col("han")).otherwise(F.col("score")).alias("score"))


def fit_binary(docs: DataFrame, labels: DataFrame, column: str, names: tuple[str, str], fit_rows: int = 4_000) -> Classifier:
    """Logistic regression on hashed words and word pairs; names: of 0 and of 1. It is fitted on about fit_rows of the
    documents that have a label, null labels aside."""
    known = docs.join(labels.where(F.col(column).isNotNull()).select("doc_id", F.col(column).cast("double").alias("y")), "doc_id").select("doc_id", "text", "y")
    chosen = _sample(known, fit_rows).select("y", word_grams(F.col("text")).alias("grams"))
    if not chosen.limit(1).count():
        return Classifier(None, [])
    steps = [HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", maxIter=20, regParam=0.01)]
    return Classifier(Pipeline(stages=steps).fit(chosen), list(names))


def binary(docs: DataFrame, labels: DataFrame, column: str, names: tuple[str, str], fit_rows: int = 4_000) -> DataFrame:
    """doc_id, label, score of every row of docs; null and 0 where there was nothing to learn from."""
    found = fit_binary(docs, labels, column, names, fit_rows).scored(docs.select("doc_id", word_grams(F.col("text")).alias("grams")))
    return found.select("doc_id", "label", "score")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """wiki (high) or cc (low)."""
    return binary(docs, labels, "quality", ("cc", "wiki"))


def toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic or non-toxic."""
    return binary(docs, labels, "toxic", ("non-toxic", "toxic"))


def nsfw(text: Column, words: tuple[str, ...] = NSFW_WORDS) -> Column:
    """nsfw or non-nsfw by a list of words; the score rises with their share. There are no labels to learn from."""
    any_ = r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b"
    hits = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(any_)).cast("double")
    share = F.lit(1.0) - F.exp(-hits)
    found = hits > 0
    return F.struct(F.when(found, "nsfw").otherwise("non-nsfw").alias("label"), F.when(found, share).otherwise(F.lit(1.0)).alias("score"))

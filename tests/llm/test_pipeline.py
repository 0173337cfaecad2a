import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import langid, packing, queries

from .data import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"


def test_language_id(spark):
    docs = odd(spark)
    model = langid.fit(docs)
    found = langid.identify(docs, model).collect()
    assert len(found) == len(odd_rows())
    texts = {i: t for i, t, *_ in odd_rows()}
    assert sorted(r["lang_pred"] == "und" for r in found if r["doc_id"] is None) == [False, True]
    for r in (r for r in found if r["doc_id"] is not None):
        none = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and (not none or r["score"] == 0)
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, langid.fit(empty(spark))).collect())
    assert langid.identify(empty(spark), model).count() == 0


def plain_grams(text):
    """Columns of all n-grams of a text, one by one."""
    s, out = f" {text.lower()} ", []
    for n in langid.ORDERS:
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
            out.append((((h ^ n) * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % langid.BUCKETS)
    return out


def test_batches_of_grams_against_counting_one_by_one(monkeypatch):
    texts = ["Abc ab", "", "x", "über die Straße", "xyz" * 50, "日本"]
    for piece in (1 << 18, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        found = [Counter() for _ in texts]
        for of, starts, column in langid.grams(texts):
            for i, a, b in zip(of, starts, [*starts[1:], len(column)], strict=True):
                found[i].update(int(x) for x in column[a:b] if x < langid.BUCKETS)
        assert found == [Counter(plain_grams(t)) for t in texts]


def test_model_against_plain_naive_bayes(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("die katze sitzt auf der matte", "de"), ("a dog and a cat", "en"), ("der hund und die katze", "de"), ("le chat est sur le tapis", "fr")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, texts=10_000)
    drawn = docs.select("lang", "text", langid.uniform(F.lit(1), F.col("doc_id"), F.col("text")).alias("u")).where("2 * u < 1").collect()
    counts = {k: Counter() for k in model.langs}
    for r in drawn:
        counts[r["lang"]].update(plain_grams(r["text"]))
    logp = {k: {c: math.log((n + 0.1) / (sum(found.values()) + 0.1 * langid.BUCKETS)) for c, n in found.items()} for k, found in counts.items()}
    floor = {k: math.log(0.1 / (sum(found.values()) + 0.1 * langid.BUCKETS)) for k, found in counts.items()}
    prior = Counter(lang for _, _, lang in rows)
    texts = ["the dog sat", "katze und hund", "chat", "zzz"]
    total, n = model.sums(texts)
    for k, lang in enumerate(model.langs):
        for i, t in enumerate(texts):
            assert abs(total[k, i] - sum(logp[lang].get(c, floor[lang]) for c in plain_grams(t))) < 1e-3 and n[i] == len(plain_grams(t))
    best, score = model.predict(texts)
    for i in range(len(texts)):
        joint = {lang: total[k, i] + math.log(prior[lang] / len(rows)) for k, lang in enumerate(model.langs)}
        assert model.langs[best[i]] == max(joint, key=joint.get)
        assert score[i] <= 1 / sum(math.exp(x - max(joint.values())) for x in joint.values()) + 1e-9


def test_junk_and_languages_that_were_not_learned_score_low(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    others = docs.where("lang <> 'es'").unionByName(docs.where("lang = 'es'").withColumn("lang", F.lit(None).cast("string")))
    rng = random.Random(3)
    letters = [(10_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(60, 2000))), None, None, 0) for i in range(100)]
    markup = [(20_000 + i, f'<div class="x{i}"><a href="/p?id={i}&q=1"></a></div>' * 5, None, None, 0) for i in range(100)]
    cyrillic = [(30_000 + i, f"Быстрая лиса прыгает через ленивую собаку {i} раз", None, None, 0) for i in range(100)]
    kept = corpus_pipeline.language_id(spark, others.unionByName(spark.createDataFrame(letters + markup + cyrillic, others.schema)), SF)
    assert kept.where("doc_id >= 10000").count() <= 3
    clean, left = docs.where("lang <> 'es'").count(), kept.where("doc_id < 10000 and lang is not null").count()
    assert 0.98 * clean < left <= clean


def test_more_labels_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    rows = [(i, f"{'the cat' if i % 2 else 'der hund'} {i}", "en" if i % 2 else "de") for i in range(50)] + [(100 + i, "junk label", f"junk{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).langs == ["de", "en", "junk0"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op7_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in found) > 0.97 * len(found) > 200


@pytest.mark.parametrize("rows", [odd, empty])
def test_stages(spark, rows):
    docs = rows(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "pack_sequences":
            assert docs.columns == columns
        if name == "language_id":
            texts = [t for _, t, *_ in odd_rows()] if rows is odd else []
            assert docs.count() <= sum(any(c.isalpha() for c in t or "") for t in texts) and (rows is empty) == (docs.count() == 0)
        if name == "near_dedup":
            assert 0 < docs.count() <= before.select("text").distinct().count() or rows is empty
    assert set(packing.SCHEMA.replace(",", "").split()[::2]) == set(docs.columns)


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mix_sources", "pack_sequences"]
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    seqs = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r["n"] <= 2048 and (r["n"] == 2048 or r["n"] & (r["n"] - 1) == 0) for r in seqs)

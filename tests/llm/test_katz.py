import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import katz, ngrams, queries

from .data import empty, odd

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split(text):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ""]


class Plain:
    """The same model, word for word."""

    def __init__(self, texts):
        self.one, self.two, after = Counter(), Counter(), defaultdict(dict)
        for t in texts:
            self.one.update(t)
            self.two.update(zip(["", *t], t))  # noqa: B905
        for (a, b), n in self.two.items():
            after[a][b] = n
        self.d1, self.d2 = (katz.discounts(np.bincount([min(n, 7) for n in c.values()] or [0], minlength=8)[:7]) for c in (self.one, self.two))
        n = sum(self.one.values())
        kept = sum(self.d1[min(c, 6)] * c for c in self.one.values())
        over = n + (n - kept <= 1e-9 * max(1, n)) if n else 0
        self.p = {w: self.d1[min(c, 6)] * c / over for w, c in self.one.items()}
        self.unknown = 1 - sum(self.p.values())
        self.over = {a: self.one[a] + (min(f.values()) > 5) for a, f in after.items()}
        self.alpha = {a: (1 - sum(self.d2[min(c, 6)] * c for c in f.values()) / self.over[a]) / (1 - sum(self.p[b] for b in f)) for a, f in after.items()}
        self.after = after

    def prob(self, a, b):
        c = self.two.get((a, b), 0)
        if c:
            return self.d2[min(c, 6)] * c / self.over[a]
        return self.alpha.get(a, 1.0) * self.p.get(b, self.unknown)


def check(rows, found):
    train = [split(t) for _, t, h in rows if not h]
    m = Plain(train)
    n, v = sum(m.one.values()), len(m.one)
    for a in [*m.after, "never seen"]:
        assert abs(sum(m.prob(a, b) for b in m.one) + m.alpha.get(a, 1.0) * m.unknown - 1) < 1e-9
    want = Counter()
    for i, t, h in rows:
        s = split(t)
        base = sum(math.log10((m.one[w] + 1) / (n + v + 1)) for w in s)
        score = sum(math.log10(m.prob(a, b)) for a, b in zip(["", *s], s))  # noqa: B905
        want[i, bool(h), len(s), sum(w in m.one for w in s), n, round(base, 6), round(score, 6)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6) + 0.0, round(r["score"], 6) + 0.0) for r in found)
    assert got == want


def corpus():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.zipf(1.4, 6000) if k < 4000]
    rows = [(i, " ".join(words[i * 25 : i * 25 + 25]), i % 7 == 2) for i in range(200)]
    return [*rows, *[(500, "same text again and again", False)] * 9, (600, "again same", True), (601, "text nothing again", True)]


def test_scores(spark):
    rows = corpus()
    model = katz.katz(spark.createDataFrame(rows, "doc_id long, text string, held boolean"))
    check(rows, model.scores.collect())
    grams = {(r["first"], r["second"]): r["n"] for r in model.grams().collect()}
    assert sum(grams.values()) == sum(len(split(t)) for _, t, h in rows if not h)


def test_small_chunks_and_hot_words(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 400)
    monkeypatch.setattr(katz, "MAX_HOT", 50)
    rows = corpus()
    rows += [(700 + i, "the the the a", i % 5 == 0) for i in range(300)]
    check(rows, katz.katz(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)).scores.collect())


def test_odd_rows(spark):
    docs = odd(spark).withColumn("held", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(7)) == 2)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "held").collect()]
    check(rows, katz.katz(docs).scores.collect())
    assert katz.katz(empty(spark).withColumn("held", F.lit(True))).scores.count() == 0
    alone = katz.katz(docs.withColumn("held", F.lit(True))).scores.collect()
    assert len(alone) == len(rows) and all(r["score"] == r["base_score"] == 0 and r["n_known"] == r["train_tokens"] == 0 for r in alone)


class PlainOrder:
    """Katz backoff of any order, word for word."""

    def __init__(self, texts, order):
        self.order, self.grams = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            padded = ["", *t]
            for j in range(1, len(padded)):
                for k in range(1, order + 1):
                    if k - 1 <= j:
                        self.grams[k][(*padded[j - k + 1 : j], padded[j])] += 1
        self.d = [None, *(katz.discounts(np.bincount([min(n, 7) for n in c.values()] or [0], minlength=8)[:7]) for c in self.grams[1:])]
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, n in self.grams[k].items():
                self.after[k][g[:-1]][g[-1]] = n
        n = sum(self.grams[1].values())
        kept = sum(self.d[1][min(c, 6)] * c for c in self.grams[1].values())
        self.over1 = n + (n - kept <= 1e-9 * max(1, n))
        self.unknown = (self.over1 - kept) / self.over1

    def seen(self, h, w):
        f = self.after[len(h) + 1][h]
        over = self.over1 if not h else sum(f.values()) + (min(f.values()) > 5)
        return self.d[len(h) + 1][min(f[w], 6)] * f[w] / over

    def p(self, h, w):
        if w in self.after[len(h) + 1].get(h, {}):
            return self.seen(h, w)
        if not h:
            return self.unknown
        f = self.after[len(h) + 1].get(h)
        alpha = 1.0 if f is None else (1 - sum(self.seen(h, x) for x in f)) / (1 - sum(self.p(h[1:], x) for x in f))
        return alpha * self.p(h[1:], w)


def test_tables_of_any_order(spark, tmp_path):
    rows = corpus()[:90] + [(1, None, False), (1, "", True), (None, "again and again", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    train = [split(t) for _, t, h in rows if not h]
    for order in (1, 3):
        plain = PlainOrder(train, order)
        for h in [(), *[h for h in plain.after[order] if len(h) == order - 1][:25], ("never", "seen")[: order - 1]]:
            assert abs(sum(plain.p(h, w) for w in plain.after[1][()]) + plain.p(h, "not a word") - 1) < 1e-9
        ngrams.train(docs.where("not held"), order, str(tmp_path / str(order)))
        model = ngrams.Model(spark, str(tmp_path / str(order)))
        want = Counter()
        for i, t, _ in rows:
            s = ["", *split(t)]
            score = sum(math.log10(plain.p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
            want[i, len(s) - 1, sum((w,) in plain.grams[1] for w in s[1:]), round(score, 6)] += 1
        found = model.score(docs.select("doc_id", "text")).collect()
        assert model.order == order and model.train_tokens == sum(map(len, train))
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in found) == want
    # order two gives the scores of the packed computation
    model = ngrams.train(docs.where("not held"), 2, str(tmp_path / "2"))
    packed = Counter((r["doc_id"], round(r["score"], 6)) for r in katz.katz(docs).scores.collect())
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in model.score(docs).collect()) == packed
    nothing = ngrams.train(docs.limit(0), 3, str(tmp_path / "0")).score(docs).collect()
    assert len(nothing) == len(rows) and all(r["score"] == 0 and r["n_known"] == 0 for r in nothing)
    assert model.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_of_the_queries(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = queries.queries()[name](spark, sf)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(want.fetchall())

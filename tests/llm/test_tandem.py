import random
import re
import zlib
from functools import cache
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries, tandem

from .data import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"


def plain_runs(s, least, times):
    """Every period and place, one by one."""
    found, n = {}, len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((i, n, q) for (i, n), q in found.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (4, 2), (6, 3)]))
def test_runs_of_small_sequences(s, limits):
    assert [tuple(r) for r in tandem.runs_of(np.array(s, np.int64), *limits)] == plain_runs(s, *limits)


def test_runs_of_periodic_sequences():
    rng = random.Random(5)
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a  # a Fibonacci word has many runs
    cases = [b, [0] * 200, [0, 1] * 80, [0, 0, 1] * 50, [*range(40)] * 4]
    for _ in range(150):
        s = []
        while len(s) < 150:
            part = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
            s += part * rng.randrange(1, 6)
        cases.append(s)
    for s in cases:
        for limits in ((2, 2), (8, 3)):
            assert tandem.runs_of(np.array(s, np.int64), *limits) == plain_runs(s, *limits)


def test_suffix_array_and_extensions():
    rng = random.Random(2)
    for n in (1, 2, 3, 40, 300):
        s = [rng.randrange(2) for _ in range(n)]
        ext = tandem.Extensions(np.array(s, np.int64))
        assert ext.order.tolist() == sorted(range(n), key=lambda i: s[i:])
        i, j = (np.array([rng.randrange(n + 1) for _ in range(200)]) for _ in range(2))
        for x, y, found in zip(i.tolist(), j.tolist(), ext(i, j).tolist(), strict=True):
            assert found == next((k for k in range(n) if x + k >= n or y + k >= n or s[x + k] != s[y + k]), 0 if max(x, y) >= n else n)


def test_texts_together(monkeypatch):
    rng = random.Random(3)
    vocabulary = [b"w%d" % i for i in range(30)]
    texts = []
    for _ in range(120):
        t = []
        for _ in range(rng.randrange(6)):
            part = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
            t += part * rng.choice([1, 1, 3, 4, 9])
        texts.append(t)
    texts += [texts[0] * 5, [], [b"x"] * 500]
    want = [plain_runs(t, 24, 3) for t in texts]
    assert sum(map(len, want)) > 50
    for together in (1 << 15, 100):
        monkeypatch.setattr(tandem, "TOGETHER", together)
        assert tandem.runs_of_texts(texts, 24, 3) == want


def changed(doc_id, w):
    """As the contract says it, word by word."""
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@cache
def plain_runs_of_words(w, least=24, times=3):
    """As plain_runs, every period one by one, by arrays."""
    number = {}
    s = np.array([number.setdefault(x, len(number)) for x in w], np.int32)
    found = {}
    for q in range(1, len(s) // times + 1):
        same = s[:-q] == s[q:]
        if np.count_nonzero(same) >= max(least, times * q) - q:
            edges = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
            for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if j + q - i >= max(least, times * q):
                    found.setdefault((i, j + q - i), q)
    return sorted((i, n, q) for (i, n), q in found.items())


def plain_row(doc_id, text):
    w = changed(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain_runs_of_words(tuple(w))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc_id, len(runs), *top, sha256(lines.encode()).hexdigest(), sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()


def test_query_against_plain_runs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = [tuple(r) for r in queries.op12_tandem(spark, SF).collect()]
    assert sorted(r[0] for r in found) == sorted(texts)
    assert all(r == plain_row(r[0], texts[r[0]]) for r in found)
    assert sum(r[1] > 0 for r in found) >= 10


def test_odd_rows(spark):
    found = sorted((tuple(r) for r in tandem.digest(tandem.collapse(odd(spark), change=tandem.repeat_tail)).collect()), key=str)
    want = {r[:2]: plain_row(*r[:2]) for r in odd_rows()}
    assert found == sorted((want[r[:2]] for r in odd_rows()), key=str)
    assert tandem.digest(tandem.collapse(empty(spark))).count() == 0
    with pytest.raises(ValueError):
        tandem.collapse(odd(spark), times=1)

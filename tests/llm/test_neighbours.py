import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import metricjoin, simhash, topk

from .data import empty, odd, odd_rows

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(n, linked):
    least = list(range(n))
    for a, b in linked:
        while least[a] != a:
            a = least[a]
        while least[b] != b:
            b = least[b]
        least[max(a, b)] = min(a, b)
    def top(x):
        while least[x] != x:
            x = least[x]
        return x
    return [top(x) for x in range(n)]


def test_odd_rows(spark):
    found = simhash.near_duplicates(odd(spark)).collect()
    rows = odd_rows()
    prints = {t: plain_print(t) for _, t, *_ in rows}
    texts = list(prints)
    of = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[texts[i]] ^ prints[texts[j]]).bit_count() <= 2])
    least = {}
    for i, t, *_ in rows:
        g = of[texts.index(t)]
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    want = Counter((i, prints[t], least[of[texts.index(t)]]) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_one_of_each_of_odd_rows(spark):
    rows = odd_rows()
    texts = sorted({t or "" for _, t, *_ in rows})
    sets = [shingles(t) for t in texts]
    of = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8])
    least = {}
    for i, t, *_ in rows:
        g = of[texts.index(t or "")]
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    docs = odd(spark).withColumns({c: F.lit(1) for c in ("_m0", "_M1", "_kept_id", "_content", "one", "mark", "node", "top", "rows", "a.b")}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())
    assert simhash.one_of_each(empty(spark)).count() == 0


def near_texts(rng, n, share, vocabulary=5_000):
    """Pairs of texts, the second with words replaced as long as `share` of all shingles, or a little more, are common."""
    out = []
    for k in range(n):
        w = [f"w{x}" for x in rng.integers(0, vocabulary, 200 + 3 * k)]
        v, mine = list(w), shingles(" ".join(w))
        while True:
            before, v[int(rng.integers(len(v)))] = list(v), f"other{rng.integers(1 << 40)}"
            if similarity(mine, shingles(" ".join(v))) < share:
                break
        out.append((" ".join(w), " ".join(before)))
    return out


def test_recall_and_precision_of_the_short_prints(spark):
    """Pairs that are near are found with a chance of 0.9 and more, down to the least similarity; no other pair is linked."""
    rng = np.random.default_rng(5)
    rows, pairs = [], {}
    for share in (0.97, 0.9, 0.85, 0.8, 0.7):
        for a, b in near_texts(rng, 100, share):
            pairs[len(rows)] = share if similarity(shingles(a), shingles(b)) >= 0.8 else 0.7
            rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = Counter(share for i, share in pairs.items() if i + 1 not in kept)
    assert all(i in kept for i in pairs) and caught[0.7] == 0
    assert caught[0.97] == 100 and caught[0.9] >= 99 and caught[0.85] >= 97 and caught[0.8] >= 90


def test_sketches_leave_out_no_near_pair():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30, 200, 3_000):
        kept = {0.8: [], 0.3: []}
        for share in kept:
            for _ in range(300):
                common = round(n * 2 * share / (1 + share)) if n > 2 else n
                shared, *own = (rng.integers(0, 1 << 64, size, np.uint64) for size in (common, n - common, n - common))
                a, b = (np.unique(np.r_[shared, x]) for x in own)
                one, two = (np.frombuffer(simhash.sketch(x), np.uint8)[None, :] for x in (a, b))
                kept[share].append(bool(simhash.may_be_near(one, two, 0.8)[0]))
        assert all(kept[0.8]) and (n < 200 or sum(kept[0.3]) < 15)
    assert simhash.sketch(np.zeros(0, np.uint64)) == bytes(64)


def test_groups_against_brute_force(spark):
    """Chains of texts each near the next, with unrelated texts that have a long passage in common. Components are those of
    all pairs that are near, but for links that no fingerprint finds, which are counted."""
    rng = np.random.default_rng(11)
    passage = [f"p{x}" for x in range(90)]
    texts = []
    for _ in range(25):
        w = [f"w{x}" for x in rng.integers(0, 5_000, 150)]
        for _ in range(8):
            texts.append(" ".join(w))
            w[int(rng.integers(len(w)))] = f"other{rng.integers(1 << 40)}"
    texts += [" ".join([*passage, *(f"u{x}" for x in rng.integers(0, 5_000, 40 + i % 60))]) for i in range(150)]
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j] and similarity(sets[i], sets[j]) >= 0.8]
    want = groups(len(texts), linked)
    near, scratch = simhash.Near(), simhash.Scratch(spark, "test")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["top"] for r in simhash.near_groups(docs, near, scratch).collect()}
    least = {}
    for i in sorted(found):
        least.setdefault(found[i], i)
    assert all(want[i] == want[least[found[i]]] for i in found)  # nothing is joined that isn't linked
    lost = [(i, j) for i, j in linked if found[i] != found[j]]
    assert len(linked) > 400 and len(lost) <= 0.05 * len(linked)


def test_hot_groups_are_dealt_out(spark, monkeypatch):
    """One group of very many near copies, and texts that share fingerprints but nothing else."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 900, 120)]
    rows = []
    for i in range(1_500):
        w = list(base)
        w[i % 120] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(5_000 + i, f"own words {i} of a text {i * i} without any other like it {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    # two texts of the group differ in two words, which is ten shingles of 116: 0.84
    assert 0 in kept and len([i for i in kept if i < 5_000]) <= 15 and len([i for i in kept if i >= 5_000]) == 300
    monkeypatch.setattr(simhash, "short_prints", lambda h, near: [0] * near.blocks)
    few = spark.createDataFrame([*rows[:40], *rows[1_500:1_512]], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(few).collect()} == {0, *range(5_000, 5_012)}


def test_unrelated_texts_with_null_or_equal_ids_stay(spark):
    texts = [(None, "the first of two texts without an id"), (None, "quite another story about boats and harbours"), (None, "quite another story about boats and harbours"), (7, "seven apples lie in a green basket"), (7, "nobody knows when the last train leaves"), (8, "seven apples lie in a green basket")]
    kept = simhash.one_of_each(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([texts[0], texts[1], texts[3], texts[4]])


def test_all_links_at_two_bits(spark):
    rng = np.random.default_rng(2)
    prints = set(int(x) for x in rng.integers(0, 1 << 63, 30))
    for x in list(prints)[:20]:
        for _ in range(4):
            x ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            prints.add(x)
    prints |= {0, 1 << 63, (1 << 63) | 1}
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "print long")).collect()
    place = {signed(x): i for i, x in enumerate(prints)}
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert groups(len(prints), [(place[r["a"]], place[r["b"]]) for r in edges]) == want


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(600):
        x = base[k % 12] + rng.normal(size=16) * 0.09 if k % 3 else rng.normal(size=16)
        rows.append((k, [float(v) for v in np.float32(x)], k % 4 if k % 11 else None))
    dup = rows[1][1]
    rows += [(700 + k, dup, rows[1][2]) for k in range(300)] + [(2000, [2 * v for v in dup], rows[1][2])]
    tiny, huge = [1e-200, 0.0, 3e-200], [1e160, 0.0, 3e160]
    rows += [(3000, tiny, 1), (3001, tiny, 1), (3002, huge, 1), (3003, huge, 1), (3004, [5e-324, 0.0, 0.0], 1), (3005, [1.7e308, 0.0, 1.0], 1), (3006, [0.0, 1e308, 1e-308], 2)]
    rows += [(1100, None, 1), (1101, [], 1), (1102, [0.0] * 16, 1), (1103, [float("nan")] * 16, 1), (1104, [1.0, None], 1), (1105, [float("inf")] * 16, 1), (1106, [1.0, 0.0], 1), (1107, [1.0, 0.0], 1), (1107, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    return rows


def cosine(x, y):
    """In fractions, but for the last root, where squares could get lost."""
    if all(1e-100 < max(map(abs, v)) < 1e100 for v in (x, y)):
        return np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    dot = lambda a, b: sum(Fraction(u) * Fraction(v) for u, v in zip(a, b, strict=True))
    s = dot(x, y)
    return math.sqrt(s * s / (dot(x, x) * dot(y, y))) * (1 if s > 0 else -1)


def fits(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_metric_join(spark, monkeypatch):
    rows = vectors()
    n = len(rows)
    linked, links = [], [0] * n
    for a in range(n):
        for b in range(a):
            (_, x, k), (_, y, m) = rows[a], rows[b]
            if k is not None and k == m and fits(x) and fits(y) and len(x) == len(y) and cosine(x, y) >= 0.98:
                linked.append((a, b))
                links[a] += 1
                links[b] += 1
    of, least = groups(n, linked), {}
    for a, (i, *_) in enumerate(rows):
        least[of[a]] = min([x for x in (least.get(of[a]), i) if x is not None], default=None)
    want = Counter((i, links[a], least[of[a]], i == least[of[a]]) for a, (i, *_) in enumerate(rows))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("times", F.lit("x")).withColumn("cell", F.lit(0))
    monkeypatch.setattr(metricjoin, "CELL", 20)
    monkeypatch.setattr(metricjoin, "BLOCK", 16)
    assert Counter(tuple(r) for r in metricjoin.near_duplicates(table).collect()) == want
    # cells are cut again and again
    monkeypatch.setattr(metricjoin, "MAX_PIVOTS", 8)
    monkeypatch.setattr(metricjoin, "LARGE", 12)
    monkeypatch.setattr(metricjoin, "FAN", 4)
    monkeypatch.setattr(metricjoin, "TASK", 30)
    assert Counter(tuple(r) for r in metricjoin.near_duplicates(table).collect()) == want
    monkeypatch.setattr(metricjoin, "MAX_PIVOTS", 2)  # labels without pivots share cells
    assert Counter(tuple(r) for r in metricjoin.near_duplicates(table).collect()) == want
    assert metricjoin.near_duplicates(table.limit(0)).count() == 0


def plain_top_k(rows, k=20):
    """(query_id, rank, vec_id, score) with Python's integers."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(64 * x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
            scores = [(clip(sum(x * y for x, y in zip(q, p))), j) for b, (j, p) in enumerate(good) if b != a]  # noqa: B905
            best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
            out.update((i, r + 1, j, s) for r, (s, j) in enumerate(best))
    return out


def found_top_k(table):
    found = topk.top_k(topk.quantised(table), F.pmod("vec_id", F.lit(20)) == 0, 20)
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.2, 1, 5])).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(60)] + [(20, rows[20][1]), (900, None), (901, [1.0, float("nan")]), (902, [None]), (903, []), (904, [0.0] * 8), (920, [-0.0] * 8), (None, [1.0] * 8), (None, [5.0] * 8), (940, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("score", "rank", "x", "norm", "run", "grp", "row")})
    want = plain_top_k(rows)
    assert any(j is None for _, _, j, _ in want)
    for numbers, bucket, queries in ((1 << 20, 1_024, 1 << 20), (512, 16, 64)):
        monkeypatch.setattr(topk, "RUN_NUMBERS", numbers)
        monkeypatch.setattr(topk, "BUCKET", bucket)
        monkeypatch.setattr(topk, "QUERY_NUMBERS", queries)
        monkeypatch.setattr(topk, "MAX_MARKS", 2 if numbers == 512 else 65_536)
        assert found_top_k(table) == want
    few = topk.top_k(topk.quantised(table.where("vec_id < 3")), F.col("vec_id") == 0, 20)
    assert few.count() == 2 and topk.top_k(topk.quantised(table.limit(0)), F.lit(True)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e20, 3e18]), (1, [1e20, 3e18]), (2, [-1e20, 1.0]), (3, [1e8 + 0.3, 7.7e8]), (20, [2.0**40 + 0.1, -(2.0**30)]), (4, [2.0**15 + 1, 2.0**20 + 3]), (5, [1e306, 0.0]), (6, [1e308, 0.0]), (7, [1.5e-300, 0.0]), (8, [0.5, 0.5])]
    rows += [(40 + i, [2.0**31 + i, 2.0**22 - 3 * i]) for i in range(30)]
    assert found_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain_top_k(rows)


def test_top_k_prunes_pairs():
    rng = np.random.default_rng(8)
    # like the embeddings: all of one length, the best cosines at about 0.3
    x = rng.normal(size=(6_000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True))
    every = {"x": x, "id": np.arange(6_000), "row": np.arange(6_000), "nameless": np.zeros(6_000, bool)}
    asks = {"x": x[::20], "row": np.arange(6_000)[::20], "least": np.zeros(300, int), "told": np.zeros(300, bool)}
    tally = Counter()
    found = topk.search_run(asks, every, 20, tally)
    scores = (x[::20] @ x.T).astype(int)
    scores[np.arange(300), np.arange(0, 6_000, 20)] = -(1 << 40)
    best = np.lexsort((np.broadcast_to(np.arange(6_000), scores.shape), -scores), axis=1)[:, :20]
    assert (found["vec_id"].reshape(300, 20) == best).all()
    assert tally["pairs"] == 300 * 6_000 and tally["verified"] < 0.5 * tally["pairs"]
    # lengths that differ prune more
    long = x * (1 + 20 * (np.arange(6_000) % 50 == 0))[:, None]
    tally = Counter()
    topk.search_run(asks | {"x": long[::20]}, every | {"x": long}, 20, tally)
    assert tally["verified"] < 0.25 * tally["pairs"]


def test_pairs_are_looked_up_once(spark, monkeypatch):
    """What the lookups of hashes read is written: no join of pairs stands below them, to be made again by each."""
    plans, lookup = [], simhash.lookup

    def watched(big, small, keys, rows, how="left"):
        if keys == ["b"]:
            plans.extend(x._jdf.queryExecution().optimizedPlan().toString() for x in (big, small.select("b", "rows")))
        return lookup(big, small, keys, rows, how)

    monkeypatch.setattr(simhash, "lookup", watched)
    texts = near_texts(np.random.default_rng(8), 4, 0.9)
    rows = [(2 * k + i, t) for k, pair in enumerate(texts) for i, t in enumerate(pair)]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 2, 4, 6} and plans and not any("LeftOuter" in x for x in plans)


def test_pairs_of_near_copies_grow_with_the_texts(spark, monkeypatch):
    """Many copies with a few words of their own, some near each other and some not: few pairs are compared for each of them, and
    none that meet and are near stay in different groups."""
    rng = np.random.default_rng(9)
    base, rows, compared = [f"w{x}" for x in rng.integers(0, 900, 150)], [], {}
    for i in range(400):
        w = list(base)
        for at in rng.choice(150, 2 if i % 2 else 5, replace=False):
            w[at] = f"x{rng.integers(1 << 40)}"
        rows.append((i, " ".join(w)))
    verified = simhash._verified

    def counted(pairs, *args):
        compared[args[-1]] = pairs.count()
        return verified(pairs, *args)

    monkeypatch.setattr(simhash, "_verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near, scratch = simhash.Near(), simhash.Scratch(spark, "test")
    top = {r["doc_id"]: r["top"] for r in simhash.near_groups(docs, near, scratch).collect()}
    # but for later rounds within one fingerprint
    assert compared["near0"] + compared.get("bridges", 0) < 4 * len(rows)
    sets = [shingles(t) for _, t in rows]
    prints = [simhash.short_prints(simhash.shingle_hashes(t, near.shingle), near) for _, t in rows]
    met = defaultdict(list)
    for i, p in enumerate(prints):
        for x in set(p):
            for flip in (0, *(1 << b for b in range(near.bits))):
                met[x ^ flip].append((i, x))
    shared = Counter(x for p in prints for x in set(p))
    # fingerprints of one text alone, so that the text is the first of them
    linked = {(i, j) for who in met.values() for i, x in who for j, y in who if i < j and shared[x] == shared[y] == 1 and similarity(sets[i], sets[j]) >= 0.8}
    assert len(linked) > 200 and all(top[i] == top[j] for i, j in linked)


def test_fine_sketches_tell_short_texts_apart():
    rng = np.random.default_rng(4)
    for n in (5, 30, 60, 120, 400):
        kept = {0.8: [], 0.65: []}
        for share in kept:
            for _ in range(300):
                common = math.ceil(n * 2 * share / (1 + share))
                shared, *own = (rng.integers(0, 1 << 64, size, np.uint64) for size in (common, n - common, n - common))
                a, b = (np.unique(np.r_[shared, x]) for x in own)
                one, two = (np.frombuffer(simhash.sketch(x, simhash.FINE), np.uint8)[None, :] for x in (a, b))
                kept[share].append(bool(simhash.may_be_near(one, two, 0.8, (np.array([len(a)]), np.array([len(b)])))[0]))
        assert all(kept[0.8]) and (not 30 <= n <= 120 or sum(kept[0.65]) < 60)
    one = np.frombuffer(simhash.sketch(np.arange(4, dtype=np.uint64) << np.uint64(61), simhash.FINE), np.uint8)[None, :]
    assert simhash.may_be_near(one, one, 0.8, (np.array([4]), np.array([5])))[0] and not simhash.may_be_near(one, one, 0.8, (np.array([4]), np.array([6])))[0]

import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, sstable, tokens
from millrace.scratch import Scratch

from .data import empty, odd, odd_rows

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_runs_give_the_ids_of_whole_texts(whole):
    e = tokens.Encoder(PATH)
    assert e.by_run
    rng = random.Random(5)
    signs = ["a", "B", "é", "É", "é", "İ", "J̌", " ", "\n", "\x1c", " ", "　", "'s", "'T", "n't", "<|endoftext|>", "<|", "1", "²", "ß", "ΑΣ", "-", "¿", "\u0085", "😀", "​", '"', "\x7f", "ab" * 40]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == whole(text)
    assert e.encode(None) == b""
    assert not tokens.Encoder(str(public_tokenizers.path("byte_bpe_50k.json"))).by_run


def test_caches_are_bounded(monkeypatch, whole):
    monkeypatch.setattr(tokens, "MAX_RUNS", 10)
    e = tokens.Encoder(PATH)
    for k in range(50):
        text = " ".join(f"word{k} thing{j}" for j in range(8))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == whole(text)
        assert len(e.known) <= 20 and len(e.pieces) <= 20


def test_packing_is_linear_in_a_documents_length():
    """100 MB of ids in one document."""
    made = []
    packer = packing.Packer(made.append)
    began = time.time()
    packer.add((1, 0, bytes(100 << 20), 25 << 20))
    rest = packer.leftover()
    assert time.time() - began < 5
    assert len(made) == 12_800 and not rest and made[-1][0][1] == 12_799 * 2048


def test_a_document_of_many_sequences(spark, whole):
    text = "some words that go on " * 90_000
    found = sorted(map(tuple, packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1), PATH, end_id=1, with_ids=True).where("doc_id = 1").select("start", "length", "ids", "ids_crc32").collect()))
    ids = b"".join(bytes(r[2]) for r in found)
    assert np.frombuffer(ids, "<u4").tolist() == [*whole(text), 1]
    assert [r[0] for r in found] == [sum(x[1] for x in found[:i]) for i in range(len(found))] and all(zlib.crc32(r[2]) == r[3] for r in found)


def test_packing(spark, whole):
    rows = odd_rows() + [(1000 + i, "some words to fill " * (i % 60), "en", "a", *odd_rows()[0][4:]) for i in range(300)]
    docs = spark.createDataFrame(rows, odd(spark).schema).repartition(5)
    for length in (64, 2048):
        found = packing.pack(docs, PATH, 1, length=length, windows=4, with_ids=True).collect()
        sums, at = {}, {}
        for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == sums.get(r["sequence_id"], 0) and r["length"] > 0
            sums[r["sequence_id"]] = r["offset"] + r["length"]
            ids = np.frombuffer(bytes(r["ids"]), "<u4")
            assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
            at.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], ids.tolist()))
        assert all(n <= length and (n == length or n & (n - 1) == 0) for n in sums.values())
        assert sum(n != length for n in sums.values()) <= length.bit_length()
        for i in {r[0] for r in rows} - {None, 0}:
            ids = whole(next(r[1] for r in rows if r[0] == i)) + [1]
            parts = sorted(at[i])
            assert sum((p[3] for p in parts), []) == ids and all(p[2] == len(ids) for p in parts)
        assert sum(p[1] for p in at[0]) == 3 * (len(whole(rows[0][1])) + 1)  # the row is there three times
        assert sum(p[1] for p in at[None]) == len(whole("no id here")) + 2
    assert packing.pack(empty(spark), PATH, 1).count() == 0


def test_leftovers_merge_in_several_levels(spark, monkeypatch, whole):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string").repartition(9)
    found = packing.pack(docs, PATH, 1, length=32, windows=3).collect()
    assert sum(r["length"] for r in found) == sum(len(whole(f"text number {i}")) + 1 for i in range(40))
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)


def test_shards(spark, whole):
    scratch = Scratch(spark, "sst")
    shards = sstable.write_shards(odd(spark), PATH, 2, scratch, shard_rows=4)
    assert shards.count() > 2
    found = sorted(sstable.read_shards(shards).collect(), key=lambda r: r["start"])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
    at = 0
    for r, (i, t, *_) in zip(found, sorted(odd_rows(), key=key), strict=True):
        ids = np.array(whole(t) + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for r in shards.collect():
        with sstable.open_input(r["path"]) as f:
            reader = sstable.Reader(f)
            every = list(reader.scan())
            assert len(every) == reader.entries == r["entries"] and sum(len(v) // 4 for _, v in every) == r["ids"]
            for i in {i for i, _ in every}:
                assert reader.get(i) == [v for j, v in every if j == i]
            assert reader.get(999_999) == []
    assert sstable.read_shards(sstable.write_shards(empty(spark), PATH, 2, Scratch(spark, "none"))).count() == 0


def test_hot_ids_fill_shards_of_their_own(spark, whole):
    rows = [(7, f"hot {i}") for i in range(400)] + [(None, "none")] * 300 + [(i, f"text {i}") for i in range(-50, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shards = sstable.write_shards(docs, PATH, 2, Scratch(spark, "hot"), shard_rows=40)
    sizes = [r["entries"] for r in shards.collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 130 and len(sizes) >= 15
    found = sorted(sstable.read_shards(shards).collect(), key=lambda r: r["start"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert order == sorted(order) and Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    ends = [r["start"] + r["n_tokens"] for r in found]
    assert [r["start"] for r in found] == [0, *ends[:-1]]


def test_files_of_many_blocks(tmp_path):
    keys = sorted([*range(-50, 3000, 3), 30, 30, 30])
    with open(tmp_path / "x", "wb") as f:
        w = sstable.Writer(f, wide=True)
        w.add(sstable.key_of(None), b"\1\0\0\0")
        for k in keys:
            w.add(sstable.key_of(k), np.full(400, abs(k) + 70_000, "<u4").tobytes())
        w.close()
    with open(tmp_path / "x", "rb") as f:
        r = sstable.Reader(f)
        assert len(r.places) > 5 and [i for i, _ in r.scan()] == [None, *keys]
        assert len(r.get(30)) == keys.count(30) and r.get(None) == [b"\1\0\0\0"] and r.get(32) == []
        assert np.frombuffer(r.get(keys[-1])[0], "<u4")[0] == keys[-1] + 70_000
        misses = sum(all(r.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in sstable._probes(sstable.key_of(i), r.bits)) for i in range(10_000, 12_000))
        assert misses < 60
    with open(tmp_path / "y", "wb") as f:
        w = sstable.Writer(f, wide=False)
        w.add(sstable.key_of(2), b"")
        with pytest.raises(ValueError):
            w.add(sstable.key_of(1), b"")

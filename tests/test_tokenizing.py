import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bpe, windows
from millrace.scratch import Scratch
from millrace.sources import checkpoints
from millrace.sources import tokens as tk
from millrace.sources import warc


def naive(counts, merges):
    """All pairs counted again for each merge."""
    words = [([bytes([b]) for b in w.encode()], n) for w, n in counts.items()]
    out = []
    for _ in range(merges):
        total = {}
        for s, n in words:
            for p in zip(s, s[1:]):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        best = max(total, key=lambda p: (total[p], p))
        out.append(best)
        words = [(bpe.merge(s, best), n) for s, n in words]
    return out


def test_learn_by_hand_and_against_counting_again():
    assert bpe.learn({"low": 5, "lower": 2, "widest": 3, "newest": 6}, 6) == [(b"s", b"t"), (b"e", b"st"), (b"o", b"w"), (b"l", b"ow"), (b"w", b"est"), (b"n", b"e")]
    assert bpe.learn({"aaaa": 1, "aaa": 1}, 3) == [(b"a", b"a"), (b"aa", b"aa"), (b"aa", b"a")]
    counts = {"the": 9, " then": 4, " there": 3, "ananas": 2, " bananen": 2, "über": 5, " überall": 1, "aaaaaa": 3}
    assert bpe.learn(counts, 40) == naive(counts, 40)
    assert bpe.learn({}, 5) == [] and bpe.learn({"a": 1}, 5) == []


def test_merges_made_together_are_those_made_one_by_one():
    """Rounds of all merges that are certain, over words as arrays, against one merge after another."""
    rng = np.random.default_rng(8)
    for size, letters, merges in ((300, 3, 60), (2_000, 8, 400), (40, 1, 12), (500, 200, 100)):
        counts = {}
        for _ in range(size):
            w = "".join(chr(97 + int(c)) for c in rng.integers(0, letters, rng.integers(1, 12)))
            counts[w] = int(rng.integers(1, 6))
        block = next(bpe._blocks(iter([pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})])))
        rows = block.to_pylist()
        symbols, n = (np.frombuffer(rows[0][k], t) for k, t in (("symbols", np.int32), ("counts", np.int64)))
        pairs, learned, rounds = bpe.Pairs(), [], 0
        pairs.add(*zip(*[(r["left"], r["right"], r["change"]) for r in rows[1:]], strict=True))
        while len(learned) < merges and (batch := pairs.next(merges - len(learned))):
            first = len(pairs.tokens) - len(batch)
            learned += [(pairs.tokens[a], pairs.tokens[b]) for a, b in batch]
            symbols, keys, changes = bpe._apply(symbols, n, [(a, b, first + k) for k, (a, b) in enumerate(batch)])
            pairs.add((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), changes.tolist())
            rounds += 1
        assert learned == bpe.learn(counts, merges) and (rounds < len(learned) or letters == 1)


def test_train_encode_decode(spark):
    texts = ["low lower lowest", "newer<|endoftext|>newest wide", "", None, "🙂 naïve\n\n\nx", "<|endoftext|>\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab, merges = bpe.train(docs, 275, [tx.END_OF_TEXT])
    assert len(merges) == 18 and vocab[274] == tx.END_OF_TEXT.encode() and not any(b"<|" in a + b for a, b in merges)
    assert bpe.train(docs, 275, [tx.END_OF_TEXT], max_driver_bytes=0) == (vocab, merges)
    assert bpe.train(docs.limit(0), 275, [], max_driver_bytes=-1)[1] == []
    codec = bpe.Codec(vocab, merges, [tx.END_OF_TEXT])
    back = docs.select("doc_id", bpe.encoder(codec)(F.col("text")).alias("ids")).select("doc_id", "ids", bpe.decoder(codec)(F.col("ids")).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in back] == [t or "" for t in texts]
    assert back[1]["ids"].count(274) == 1
    assert list(codec.encode_iterable(["low ", "low"])) == codec.encode("low ") + codec.encode("low")
    assert codec.decode([104, 9999, 255]) == "h�"
    longest = bpe.Codec(vocab, merges, ["S", "SS"])
    assert [longest.vocab[i] for i in longest.encode("xSSyS") if longest.vocab[i].startswith(b"S")] == [b"SS", b"S"]


def test_token_tables_and_vocabularies(spark, tmp_path):
    scratch = Scratch(spark, "t")
    rows = spark.createDataFrame([(2, [1, 65535]), (1, []), (3, None)], "doc_id long, ids array<int>")
    tk.write_token_table(rows, scratch.path("ids"))
    assert {r["doc_id"]: r["ids"] for r in tk.read_token_table(spark, scratch.path("ids")).collect()} == {1: [], 2: [1, 65535], 3: None}
    (tmp_path / "x.bin").write_bytes(b"\x01\x00\xff\xff")
    assert tk.read_token_files(spark, str(tmp_path / "x.bin")).first()["ids"] == [1, 65535]
    vocab, merges = {0: b"a", 1: b" b", 2: b"\xff"}, [(b"a", b" b")]
    tk.write_vocabulary(spark, scratch.path("v"), vocab, merges)
    assert tk.read_vocabulary(spark, scratch.path("v")) == (vocab, merges)
    (tmp_path / "vocab.json").write_text('{"a": 0, "\\u0120b": 1}')
    (tmp_path / "merges.txt").write_text("#version: 0.2\n\na Ġb\nbroken\n")
    assert tk.read_printable(spark, str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt")) == ({0: b"a", 1: b" b"}, merges)
    state = spark.createDataFrame([("_orig_mod.w", [1.0])], "name string, vals array<double>")
    checkpoints.save_checkpoint(state, 7, scratch.path("c"))
    loaded, iteration = checkpoints.load_checkpoint(spark, scratch.path("c"))
    assert iteration == 7 and loaded.first()["name"] == "w"
    config = tk.RunConfig(tk.Paths("a", "b", "c"), training=tk.Training(steps=5))
    assert tk.RunConfig.from_json(config.to_json()) == config and tk.RunConfig.from_json('{"paths": {"train": "a", "valid": "b", "out": "c"}}').model == tk.ModelConfig()
    weights = {"w": np.arange(6.0).reshape(2, 3), "_orig_mod.b": np.ones(1)}
    tk.save_pretrained(spark, tk.ModelConfig(vocab=7), weights, scratch.path("m"))
    model, found = tk.from_pretrained(spark, scratch.path("m"))
    assert model == tk.ModelConfig(vocab=7) and set(found) == {"w", "b"} and (found["w"] == weights["w"]).all()


def test_warc(spark, tmp_path):
    def record(kind, url, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        return head + body + b"\r\n\r\n"

    page = record("response", "http://a", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>")
    data = gzip.compress(record("warcinfo", "", b"x")) + gzip.compress(page) + gzip.compress(record("conversion", "http://a", b"hi"))
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "y.warc").write_bytes(page)
    assert sorted((r["url"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [("http://a", b"<p>hi</p>")] * 2
    assert [bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path), ("conversion",)).collect()] == [b"hi"]


def test_warc_records_end_where_their_length_says(spark, tmp_path):
    """A page whose text reads like another record is one record, wherever files are cut; so are records without a length."""
    forged = b"AAA\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://evil/\r\nContent-Length: 0\r\n\r\n"
    rows = [(f"http://a/{i}", "response" if i % 3 else "conversion", forged * (i % 5) + bytes([i % 256]) * (i * 7)) for i in range(300)]
    records = [warc.as_record(*r) for r in rows]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    want = sorted(rows)
    for name in ("members.warc.gz", "one.warc.gz", "plain.warc"):
        for share in (1 << 30, 3_000):
            found = warc.read_warc(spark, str(tmp_path / name), warc.KINDS, share=share)
            assert sorted((r["url"], r["warc_type"], bytes(r["payload"])) for r in found.collect()) == want
            assert (found.rdd.getNumPartitions() > 3) == (share == 3_000 and name != "one.warc.gz")
    index = warc.places(spark, str(tmp_path), 3_000)
    assert warc.read_warc(spark, str(tmp_path), warc.KINDS, index=index, share=3_000).count() == 900
    for pushed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        assert warc.read_warc(spark, str(tmp_path / "plain.warc"), warc.KINDS).where("warc_type = 'response'").count() == 200
    assert warc.read_warc(spark, str(tmp_path), most=7, share=3_000).count() == 7


def test_warc_odd_files(spark, tmp_path):
    good = warc.as_record("http://a", "response", b"x")
    odd = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://b\r\n\r\nno length\r\n\r\n"
    cases = {
        "junk": (b"some junk\r\n" + good, [("http://a", b"x")]),
        "no_length": (odd + good, [("http://b", b"no length"), ("http://a", b"x")]),
        "no_length_last": (good + odd, [("http://a", b"x"), ("http://b", b"no length")]),
        "cut": (good[:-5], [("http://a", b"")]),
        "only_head": (good[:30], [(None, b"")]),
        "blank": (b"\r\n\r\n", []),
        "long": (odd.replace(b"no length", b"y" * 3_000_000) + good, [("http://b", b"y" * 3_000_000), ("http://a", b"x")]),
    }
    for name, (data, want) in cases.items():
        for how, as_ in (("plain", bytes), ("zipped", gzip.compress)):
            (tmp_path / f"{name}.{how}").write_bytes(as_(data))
            for read in (lambda p: warc.read_warc(spark, p), lambda p: warc._whole_files(spark, p, ("response",))):
                assert [(r["url"], bytes(r["payload"])) for r in read(str(tmp_path / f"{name}.{how}")).collect()] == want, (name, how)


def test_warc_written_in_two_steps(spark, tmp_path):
    rows = spark.createDataFrame([("http://a\nWARC-Type: x", "response", bytearray(b"1")), (None, None, None)], "url string, warc_type string, payload binary")
    for _ in range(2):  # what is there is replaced
        warc.write_warc(rows, str(tmp_path / "w"))
        found = warc.read_warc(spark, str(tmp_path / "w"), ("response", ""))
        assert sorted((r["url"] or "", bytes(r["payload"])) for r in found.collect()) == [("", b""), ("http://aWARC-Type: x", b"1")]
    bad = rows.select("url", "warc_type", F.expr("CAST(raise_error('no') AS binary)").alias("payload"))
    with pytest.raises(Exception, match="no"):
        warc.write_warc(bad, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w"), ("response", "")).count() == 2
    assert [p.name for p in (tmp_path / "w").iterdir() if p.name.startswith("_")] == []


def test_windows(spark):
    row = spark.createDataFrame([(list("abcdefg"), ["z"])], "t array<string>, s array<string>")
    assert [(w["start"], "".join(w["x"]), "".join(w["y"])) for w in row.select(windows.context_windows(F.col("t"), 3, 2).alias("w")).first()["w"]] == [(0, "abc", "bcd"), (2, "cde", "def")]
    assert row.select(windows.context_windows(F.col("s"), 3, 2).alias("w")).first()["w"] == []
    assert [(p["x"], p["y"]) for p in row.select(windows.next_tokens(F.slice("t", 1, 3)).alias("p")).first()["p"]] == [("a", "b"), ("b", "c")]
    assert row.select(windows.last_tokens(F.col("t"), 2).alias("x")).first()["x"] == ["f", "g"]
    p = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.2), ("d", 0.1)], "item string, p double")
    assert sorted(r["item"] for r in windows.top_k(p, 2).collect()) == ["a", "b", "c"]
    kept = {r["item"]: r["p"] for r in windows.top_p(p, 0.6).collect()}
    assert set(kept) == {"a", "b"} and abs(sum(kept.values()) - 1) < 1e-12
    assert windows.draw(p, 0.65).first()["item"] == "b"
    sizes = spark.createDataFrame([([3.0, 3.0, 10.0, 1.0, 4.0, 5.0],)], "s array<double>")
    assert sizes.select(windows.size_buckets(F.col("s"), 6.0).alias("b")).first()["b"] == [0, 0, 1, 2, 2, 3]


def test_warc_of_broken_text_stops_early(spark, tmp_path):
    records = spark.createDataFrame([("http://a", "response", bytearray(b"\xff\xfe<p>\r\n\r\nx")), ("http://b", "conversion", bytearray("é\n\nb".encode())), (None, "response", None), ("http://c", "request", bytearray(b"GET"))], "url string, warc_type string, payload binary")
    for compression in ("gzip", "none"):
        warc.write_warc(records, str(tmp_path / compression), compression)
        found = warc.read_warc(spark, str(tmp_path / compression), ("response", "conversion"))
        assert {(r["url"], r["warc_type"], bytes(r["payload"])) for r in found.collect()} == {("http://a", "response", b"\xff\xfe<p>\r\n\r\nx"), ("http://b", "conversion", "é\n\nb".encode()), (None, "response", b"")}
    many = spark.range(5_000).select(F.lit("u").alias("url"), F.lit("response").alias("warc_type"), F.encode(F.repeat(F.lit("x"), 2_000), "UTF-8").alias("payload"))
    warc.write_warc(many.coalesce(1), str(tmp_path / "many"), "none")
    assert warc.read_warc(spark, str(tmp_path / "many")).count() == 5_000
    assert warc.read_warc(spark, str(tmp_path / "many"), most=10).count() == 10
    (tmp_path / "empty.warc").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path / "empty.warc")).count() == 0


def test_random_windows_and_batches(spark):
    rows = spark.createDataFrame([(i, list(range(100 * i, 100 * i + 5 + i))) for i in range(12)], "doc_id long, tokens array<int>")
    found = windows.random_windows(rows, 8, 3, seed=1).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(3 * list(range(4, 12)))
    assert all(r["x"] == list(range(100 * r["doc_id"] + r["start"], 100 * r["doc_id"] + r["start"] + 8)) and r["y"] == [t + 1 for t in r["x"]] for r in found)
    again = windows.random_windows(rows.repartition(3), 8, 3, seed=1)
    assert sorted(map(tuple, ((r["doc_id"], r["start"]) for r in again.collect()))) == sorted((r["doc_id"], r["start"]) for r in found)
    one, two = ([(x.tolist(), y.tolist()) for x, y in windows.batches(again, 5, seed=s)] for s in (1, 2))
    assert [len(x) for x, _ in one] == [5, 5, 5, 5, 4] and one != two
    assert sorted(map(tuple, sum((x for x, _ in one), []))) == sorted(map(tuple, sum((x for x, _ in two), [])))

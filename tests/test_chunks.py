import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bpe
from millrace.streaming import chunks

TEXTS = [
    "they're we'll I've it's  x   y\n\n z 'r 'll '' 12 34<|endoftext|> a<|endoftext|><|endof text|>", "  ", "", "a", "<|endoftext|>", "naïve 🙂🙂\n\n\n'", "the end  <|endoftext|>  the end",
]


def codec():
    counts = {}
    for w in " they re we ll the end naïve x y text over and over".split(" "):
        counts[" " + w] = counts.get(" " + w, 0) + 3
    merges = bpe.learn(counts, 40)
    tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges] + [tx.END_OF_TEXT.encode()]
    return bpe.Codec(dict(enumerate(tokens)), merges, [tx.END_OF_TEXT])


def test_settled_text_is_split_the_same_whatever_follows():
    c, rng = codec(), random.Random(2)
    for text in TEXTS:
        for end in range(len(text) + 1):
            n = chunks.settled(c, text[:end])
            assert c.encode(text[:n]) + c.encode(text[n:]) == c.encode(text)
    signs = ["a", " ", "\n", "'", "s", "r", "e", "l", "<|", "endof", "<|endoftext|>", "1", "!", "é"]
    for _ in range(3_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        end = rng.randrange(len(text) + 1)
        n = chunks.settled(c, text[:end])
        assert c.encode(text[:n]) + c.encode(text[n:]) == c.encode(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_those_of_whole_texts_after_a_restart_too(spark, tmp_path, seed):
    c, rng = codec(), random.Random(seed)
    rows = []
    for k, text in enumerate([*TEXTS, "word and " * 400]):
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(8)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows += [(f"s{k}", i, p) for i, p in enumerate([*parts, None])]
    rng.shuffle(rows)
    rows += rows[:5]  # some come twice
    third = -(-len(rows) // 3)
    for turn in range(3):  # three runs of the query, one after another
        some = rows[turn * third : (turn + 1) * third]
        spark.createDataFrame(some, "stream string, seq long, chunk string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("stream string, seq long, chunk string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        query = chunks.encode_chunks(stream, c).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
    found = {r["stream"]: [x for p in sorted(r["parts"]) for x in p["ids"]] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("stream").agg(F.collect_list(F.struct("part", "ids")).alias("parts")).collect()}
    for k, text in enumerate([*TEXTS, "word and " * 400]):
        assert found.get(f"s{k}", []) == c.encode(text)

import random

import pytest

from millrace.operators import bpe, merging


@pytest.mark.parametrize(("tasks", "kept"), [(1, None), (3, None), (2, 30)])
def test_merges_in_step(spark, tasks, kept):
    """The merges are those made one by one, runs of one sign and ties among them; pairs that aren't held are counted again."""
    draw = random.Random(tasks)
    counts = {"".join(draw.choice("abcé ") for _ in range(draw.randint(1, 12))): draw.randint(1, 9) for _ in range(1500)}
    counts |= {"a" * n: n for n in range(1, 40)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert merging.learn(words, 400, tasks, kept) == bpe.learn(counts, 400)


def test_merges_end(spark):
    """Where no pair is left, and of no words at all."""
    words = spark.createDataFrame([("abab", 2), ("b", 9)], "word string, n long")
    assert merging.learn(words, 50, 2) == bpe.learn({"abab": 2, "b": 9}, 50)
    assert merging.learn(words.limit(0), 50, 2) == []


def test_jobs_of_training(spark):
    """Training on words that stay in the tasks takes a few jobs, however many merges there are."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 997}" for j in range(50))) for k in range(40)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("training", "")
    learned = bpe.train(docs, 456, [], max_driver_bytes=0)[1]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("training")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(learned) == 200 and 0 < len(jobs) <= 12

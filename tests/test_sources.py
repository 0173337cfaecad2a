from pyspark.sql import functions as F

from millrace.ordering import places_in_groups
from millrace.scratch import Scratch
from millrace.sources import text
from millrace.streaming import encode


def test_whole_files_and_parts_between_delimiters(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é one<|endoftext|>two\nlines<|endoftext|>".encode())
    (tmp_path / "b.txt").write_bytes(b"broken \xff here")
    (tmp_path / "c.txt").write_bytes(b"")
    found = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in text.whole_files(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "é one<|endoftext|>two\nlines<|endoftext|>", "b.txt": "broken \ufffd here"}  # a file without bytes has no row
    parts = sorted(r["text"] for r in text.delimited(spark, str(tmp_path / "a.txt")).collect())
    assert parts == ["two\nlines", "é one"]
    large = "<|endoftext|>".join(f"document {i} " * 50 for i in range(2_000))
    (tmp_path / "large.txt").write_text(large)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # files are split anywhere, documents aren't
    try:
        parts = text.delimited(spark, str(tmp_path / "large.txt"))
        assert parts.rdd.getNumPartitions() > 5 and sorted(r["text"] for r in parts.collect()) == sorted(large.split("<|endoftext|>"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_metrics_are_appended_once(spark, tmp_path):
    schema = "step long, name string, value double"
    for turn in range(3):
        if turn < 2:
            spark.createDataFrame([(turn, "loss", 1.0 / (turn + 1))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        encode.log_metrics(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r["step"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1.0), (1, 0.5)]


def test_places_in_groups(spark):
    rows = [("hot", i) for i in range(500)] + [("a", 3), ("a", 1), (None, 7), (None, 2), ("b", 5)]
    table = spark.createDataFrame(rows, "g string, k long").repartition(7).withColumn("_m0", F.lit(1))
    found = places_in_groups(Scratch(spark, "t"), table, "g", [F.col("k")], "at", "n", "rows").collect()
    assert {(r["g"], r["k"]): (r["at"], r["n"]) for r in found} == {("hot", i): (i, 500) for i in range(500)} | {("a", 1): (0, 2), ("a", 3): (1, 2), (None, 2): (0, 2), (None, 7): (1, 2), ("b", 5): (0, 1)}

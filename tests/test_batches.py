import numpy as np
import pyarrow as pa

from millrace.operators import dedup
from millrace.plans import streams
from millrace.session import small_batches
from millrace.sources import flat


def test_slices_by_length():
    """Parts of a batch are bounded by what their rows hold, not by how many there are; a longer row is alone."""
    lengths = np.array([0, 3 << 20, 1 << 20, (1 << 20) + 1, 1 << 20, 0, *[1] * 9000])
    parts = list(flat.slices(pa.RecordBatch.from_pydict({"n": lengths}), 0))
    assert np.array_equal(np.concatenate([p.column(0).to_numpy() for p in parts]), lengths)
    assert all(p.num_rows == 1 or sum(p.column(0).to_pylist()) <= flat.PIECE // 4 for p in parts)


def test_small_batches(spark):
    """Batches are small inside, and the setting is as it was outside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 1000) AS t")
    with small_batches(spark, "100k"):
        sizes = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert len(sizes) >= 15 and sum(r["n"] for r in sizes) == 2000 and spark.conf.get(key, None) == before


def test_ids_of_bytes(spark):
    docs = spark.createDataFrame([(1, "aé"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in streams.byte_ids(docs).collect()} == {1: [97, 195, 169, 256], 2: [256], 3: [256]}


def test_signatures_leave_in_parts(spark):
    """A batch of texts comes back as batches of 256 signatures, so texts are made words one at a time."""
    docs = spark.range(0, 700, 1, 1).selectExpr("cast(id AS int) AS doc_id", "concat('a b c d e f ', id % 7) AS text")
    signed = dedup.signatures(docs)
    assert signed.schema["doc_id"].dataType.simpleString() == "int"
    found = {r["doc_id"]: tuple(r["signature"]) for r in signed.collect()}
    assert len(found) == 700 and len(set(found.values())) == 7
    assert "MapInArrow" in signed._jdf.queryExecution().toString()

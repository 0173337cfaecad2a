import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import flat, stores


def documents(n=200):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(65536) for _ in range(rng.randrange(40))]) for i in range(n)]
    return [*rows, (None, [1, 2]), (n, None), (5, [7]), (n + 1, [])]


@pytest.mark.parametrize("parts", [False, True])
def test_written_and_read_back(spark, tmp_path, monkeypatch, parts):
    if parts:  # as in a store that can't be written at a place
        monkeypatch.setattr(flat, "_takes_places", lambda where: False)
    rows = documents()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, ids array<int>, start string, length int").repartition(5)
    for _ in range(2):  # what is there is replaced
        placed = flat.write_flat(table, str(tmp_path / "t.bin"))
    found = sorted((r["start"], r["length"], r["doc_id"], r["ids"]) for r in flat.read_at(placed, str(tmp_path / "t.bin")).collect() if r["length"])
    assert sorted(((i is not None, i or 0), ids) for _, _, i, ids in found) == sorted(((i is not None, i or 0), ids) for i, ids in rows if ids)
    ends = 0
    for start, n, _, ids in found:
        assert start == ends and n == len(ids)
        ends += n
    stream = [x for *_, ids in found for x in ids]
    assert [x for r in sorted(flat.read_flat(spark, str(tmp_path / "t.bin"), 100).collect()) for x in r["ids"]] == stream
    if not parts:
        assert np.fromfile(tmp_path / "t.bin", "<u2").tolist() == stream
        assert [p.name for p in tmp_path.iterdir()] == ["t.bin"]
    with pytest.raises(Exception, match="65535"):
        flat.write_flat(spark.createDataFrame([(1, [3, 70_000])], "doc_id long, ids array<int>"), str(tmp_path / "t.bin"))
    assert flat.Flat(str(tmp_path / "t.bin")).total == len(stream)  # nothing of the failed one shows
    assert flat.write_flat(table.limit(0), str(tmp_path / "none")).count() == 0 and flat.read_flat(spark, str(tmp_path / "none")).count() == 0


def test_windows_over_the_stream(spark, tmp_path):
    stream = np.arange(5_000, dtype="<u2")
    stream.tofile(tmp_path / "t.bin")
    path = str(tmp_path / "t.bin")
    found = flat.random_windows(spark, path, 7, 32, 40, seed=5).collect()
    assert len(found) == 32 * 40 and all(r["x"] == list(range(r["start"], r["start"] + 7)) and r["y"] == [v + 1 for v in r["x"]] for r in found)
    starts = {(r["step"], r["item"]): r["start"] for r in found}
    assert all(0 <= s <= 4_992 for s in starts.values()) and len(set(starts.values())) > 1_000
    want = lambda k: int(hashlib.md5(f"5:{k}".encode()).hexdigest()[:12], 16) % 4_993
    assert all(s == want(step * 32 + item) for (step, item), s in starts.items())
    later = flat.random_windows(spark, path, 7, 32, 2, seed=5, first_step=38).collect()  # goes on from a step
    assert {(r["step"], r["item"]): r["start"] for r in later} == {k: s for k, s in starts.items() if k[0] >= 38}
    assert flat.random_windows(spark, path, 5_000, 4, 3, seed=5).count() == 0


def test_epochs(spark, tmp_path):
    np.arange(1_001, dtype="<u2").tofile(tmp_path / "t.bin")
    path = str(tmp_path / "t.bin")
    one, two = (sorted((r["step"], r["item"], r["start"]) for r in flat.epoch_windows(spark, path, 10, 16, 3, epoch).collect()) for epoch in (0, 1))
    assert sorted(s for *_, s in one) == sorted(s for *_, s in two) == list(range(0, 1_000, 10)) and one != two
    assert [x for x in one if x[0] >= 4] == sorted((r["step"], r["item"], r["start"]) for r in flat.epoch_windows(spark, path, 10, 16, 3, first_step=4).collect())
    for room in (1, 2, 3, 100, 1025):
        assert sorted(flat.shuffled(np.arange(room), room, 9).tolist()) == list(range(room))


def test_boundaries_of_files(spark, tmp_path):
    rng = random.Random(1)
    for mark in (b"<|endoftext|>", b"\n"):
        data = mark.join(bytes(rng.randrange(97, 123) for _ in range(rng.randrange(400))) for _ in range(100))
        (tmp_path / "x").write_bytes(data)
        for chunks in (1, 2, 7, 50):
            want = {0, len(data)}
            for k in range(1, chunks):
                at = data.find(mark, k * (len(data) // chunks))
                want.add(at if at >= 0 else len(data))
            for piece in (5, 4096):
                assert flat.file_boundaries(str(tmp_path / "x"), chunks, mark, piece) == sorted(want)
        parts = sorted(flat.file_chunks(spark, str(tmp_path / "x"), 7, mark).collect())
        assert b"".join(bytes(r["content"]) for r in parts) == data and all(bytes(r["content"]).startswith(mark) for r in parts[1:])
    (tmp_path / "empty").write_bytes(b"")
    assert flat.file_boundaries(str(tmp_path / "empty"), 3, b"x") == [0] and flat.file_chunks(spark, str(tmp_path / "empty"), 3, b"x").count() == 0


def test_more_than_two_gigabytes(tmp_path):
    with open(tmp_path / "big", "wb") as f:  # a file with a hole
        f.truncate(5 << 30)
        f.seek((5 << 30) - 4)
        f.write(b"\x01\x00\x02\x00")
    file = flat.Flat(str(tmp_path / "big"))
    assert file.total == 5 << 29 and file.read((5 << 29) - 3, 10) == b"\0\0\x01\0\x02\0"


def test_stores(tmp_path):
    assert stores.store("file:///a/b")[1] == "/a/b" and stores.store("/a")[1] == "/a"
    with pytest.raises(ValueError):
        stores.store("viewfs://store/x")

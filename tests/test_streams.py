from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import charset, html, multiset
from millrace.operators import classify, dedup, windows
from millrace.sources import checkpoints


def test_code_pages():
    cases = {
        "cp1251": "Быстрая коричневая лиса прыгает через ленивую собаку. Привет, мир!",
        "koi8-r": "Быстрая коричневая лиса прыгает через ленивую собаку",
        "cp1253": "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
        "shift_jis": "私たちのウェブサイトへようこそ。今日は天気がいいですね。",
        "euc_jp": "私たちのウェブサイトへようこそ。今日は天気がいいですね。",
        "gb18030": "欢迎来到我们的网站,今天天气很好",
        "big5": "歡迎來到我們的網站,今天天氣很好",
        "euc_kr": "우리 웹사이트에 오신 것을 환영합니다",
        "cp1252": "Fußgänger überqueren “die” Straße – señor, où êtes-vous ?",
        "mac_roman": "Fußgänger überqueren die Straße, señor, où êtes-vous ?",
        "cp850": "Fußgänger überqueren die Straße, señor, où êtes-vous ?",
        "utf-16-le": "plain letters",
        "utf-16-be": "plain letters",
        "utf-8": "naïve",
    }
    for page, text in cases.items():
        assert charset.detect(text.encode(page)) == page and html.decode_bytes(text.encode(page)) == text
    assert charset.detect(b"") == charset.detect(b"plain") == "utf-8"
    assert html.decode_bytes('<meta charset="cp1250">čas'.encode("cp1250")).endswith("čas")  # what the page says goes first


def test_same_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (None, ""), (3, "b,1:c")]
    one = spark.createDataFrame(rows, "x long, y string")
    assert multiset.same_rows(one, one.repartition(7).orderBy(F.desc("y")))
    for other in (rows[1:], [*rows, rows[2]], [*rows[:2], (2, ""), *rows[3:]], [*rows[:4], (3, "b")], [(1, "a"), (2, "a"), *rows[2:]]):
        assert not multiset.same_rows(one, spark.createDataFrame(other, one.schema))
    assert not multiset.same_rows(one, one.withColumnRenamed("y", "z")) and multiset.same_rows(one.limit(0), one.limit(0))


def test_draws_by_weight(spark):
    weights = {("g", "a"): 1.0, ("g", "b"): 3.0, ("g", "c"): 0.0, ("h", "x"): 5.0, ("h", "y"): 5.0, ("none", "z"): 0.0}
    table = spark.createDataFrame([(*k, w) for k, w in weights.items()] + [("g", None, 6.0)], "group string, item string, weight double")
    found = windows.draws(table, 4_000, 3).collect()
    n = Counter((r["group"], r["item"]) for r in found)
    assert abs(n["g", "a"] - 400) < 80 and abs(n["g", "b"] - 1200) < 120 and abs(n["g", None] - 2400) < 150 and n["g", "c"] == 0
    assert abs(n["h", "x"] - 2_000) < 160 and sum(n.values()) == 8_000
    assert sorted(map(tuple, windows.draws(table.repartition(5), 50, 3).collect()), key=str) == sorted((tuple(r) for r in found if r["draw"] < 50), key=str)
    order = sorted(map(tuple, windows.draw_without_return(table, 2, 3).collect()), key=str)
    assert Counter(r[0] for r in order) == {"g": 2, "h": 2} and len({(r[0], r[2]) for r in order}) == 4
    assert windows.draws(table.limit(0), 3, 1).count() == 0


def test_a_killed_write_leaves_the_version_before(spark, tmp_path):
    log = checkpoints.Log(spark, str(tmp_path / "log"))
    assert log.read() is None and log.versions() == []
    state = spark.createDataFrame([("a", 1.0)], "name string, value double")
    log.write(1, {"state": state, "other": state.limit(0)}, {"step": 7})
    bad = state.withColumn("value", F.expr("CAST(raise_error('killed') AS double)"))
    with pytest.raises(Exception, match="killed"):
        log.write(2, {"other": state, "state": bad})
    version, tables, notes = log.read()
    assert version == 1 and notes == {"step": 7} and tables["state"].collect() == state.collect() and tables["other"].count() == 0
    with pytest.raises(ValueError, match="already"):
        log.write(1, {"state": state})
    log.write(2, {"state": state.withColumn("value", F.lit(2.0))})
    log.write(3, {"state": state})
    assert log.read(2)[1]["state"].first()["value"] == 2.0
    log.keep(1)
    assert log.versions() == [3] and log.read()[1]["state"].count() == 1
    with pytest.raises(ValueError):
        checkpoints.load_checkpoint(spark, str(tmp_path / "nothing"))


def test_languages_with_chinese_characters(spark):
    japanese = [(i, f"私たちは今日{i}時に東京駅へ行きます。天気がいいですね", "ja") for i in range(30)]
    english = [(100 + i, f"we go to the station at {i} today", "en") for i in range(30)]
    chinese = [(200, "欢迎来到我们的网站", None)]
    schema = "doc_id long, text string, lang string"
    both = spark.createDataFrame(japanese + english, schema)
    found = {r["doc_id"]: r["label"] for r in classify.language(both, both).collect()}
    assert all(found[i] == "ja" for i in range(30)) and all(found[100 + i] == "en" for i in range(30))
    learned = spark.createDataFrame(english, schema)
    found = {r["doc_id"]: r["label"] for r in classify.language(spark.createDataFrame(japanese[:1] + chinese, schema), learned).collect()}
    assert found == {0: "ja", 200: "zh"}


def test_clusters_of_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (1, "quite another text about harbours and boats"), (2, base.replace("w100 ", "x ")), (None, base), (None, "no other is like this one at all"), (7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for exact in (False, True):
        found = Counter((r["doc_id"], r["cluster"]) for r in dedup.minhash_clusters(docs, dedup.MinHash(hashes=500, bands=50), exact=exact).collect())
        assert found == {(1, 1): 2, (2, 1): 1, (None, 1): 1, (None, None): 2, (7, 7): 1}

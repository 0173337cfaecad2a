import regex
from pyspark.sql import functions as F

from millrace.functions import gopher, html, pii
from millrace.functions import text as tx
from millrace.operators import classify
from millrace.sources import text as source


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first()["r"]


def test_masks(spark):
    for kind, text, want, n in [
        ("email", "Write to a.b@example.com now.", "Write to |||EMAIL_ADDRESS||| now.", 1),
        ("email", "x@example.com and y@example.org", "|||EMAIL_ADDRESS||| and |||EMAIL_ADDRESS|||", 2),
        ("email", "|||EMAIL_ADDRESS||| x@example.com", "|||EMAIL_ADDRESS||| |||EMAIL_ADDRESS|||", 1),
        ("phone", "call 5551234567", "call |||PHONE_NUMBER|||", 1),
        ("phone", "call (555)-123-4567", "call |||PHONE_NUMBER|||", 1),
        ("phone", "call (555) 123 4567", "call |||PHONE_NUMBER|||", 1),
        ("phone", "call 555-123-4567", "call |||PHONE_NUMBER|||", 1),
        ("ip", "host 192.0.2.17.", "host |||IP_ADDRESS|||.", 1),
        ("ip", "host 300.0.2.17", "host 300.0.2.17", 0),
    ]:
        r = one(spark, pii.mask(F.col("t"), kind), t=text)
        assert (r["text"], r["n"]) == (want, n)


def test_rules(spark):
    ok = "These words are fine for a test. " * 20
    rows = [(ok, True), ("too few words here", False), ("a b " * 100, False), ("incomprehensibilities " * 60, False), ((ok.strip() + "...\n") * 5, False), ("word 123 456 789 " * 40, False), (None, False), ("", False)]
    found = spark.createDataFrame(rows, "t string, ok boolean").select(gopher.passes(F.col("t")).alias("r"), "ok").collect()
    assert all(r["r"] == r["ok"] for r in found)


def test_pretokens_as_the_pattern_has_them(spark):
    texts = ["", "Hello, how are you?", "a b  c\n\n\nd", "it's 3² ok　x \t", "\u0085y\u001cz", "naïve 日本 🙂!!"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.pretokens(F.col("t")).alias("p")).collect()
    for r in found:
        assert r["p"] == regex.findall(tx.PRETOKEN, texts[r["i"]])


def test_special_tokens(spark):
    assert one(spark, tx.split_special(F.col("t"), ["<s>", "<s><s>"]), t="a<s><s>b\n<s>\n") == ["a", "<s><s>", "b\n", "<s>", "\n"]
    assert one(spark, tx.split_special(F.col("t"), ["<s>"], keep=False), t="<s>a<s>b") == ["a", "b"]


def test_bytes_and_signs(spark):
    assert one(spark, tx.utf8(F.col("t")), t="aé") == [97, 195, 169]
    signs = tx.byte_signs()
    assert len(set(signs.values())) == 256 and signs[32] == "Ġ" and signs[10] == "Ċ"
    data = bytes(range(256))
    row = spark.createDataFrame([(bytearray(data),)], "d binary").select(tx.to_signs(F.col("d")).alias("s"))
    assert bytes(row.select(tx.from_signs(F.col("s")).alias("d")).first()["d"]) == data


def test_shingles(spark):
    assert one(spark, tx.shingles(tx.normalised(F.col("t"))), t="One, two three four five six; one two three four five!") == [
        "one two three four five", "two three four five six", "three four five six one", "four five six one two", "five six one two three", "six one two three four",
    ]
    assert one(spark, tx.shingles(F.col("t")), t="two words") == ["two words"]
    assert one(spark, tx.shingles(F.col("t")), t="") == []


def test_html():
    page = """<html><head><title>no</title></head><body><h1>A  title</h1><div><p>One
      two <a href="x">three</a>.</p><img src="a.jpg" title="t"/><img alt="shown"><script>var x = "</p>";</script></div>
      <ul><li>first<li>second</ul><p>a<br>b &amp; c</body>"""
    assert html.extract_text(page) == "A title\n\nOne two three.\n\nshown\n\n  • first\n  • second\n\na\nb & c"
    assert html.extract_text("") == "" and html.extract_text(None) is None
    assert html.decode_bytes("é".encode()) == "é" and html.decode_bytes(b'<meta charset="latin-1">\xe9').endswith("é")
    assert html.decode_bytes(b"\xff\xfea\x00") == "a" and html.decode_bytes(b"\xe9") == "é"  # told by the signs


def test_boundaries_and_first_characters(spark):
    assert one(spark, source.chunk_boundaries(F.col("t"), 3, "|"), t="aaaa|bbbb|cccc") == [0, 4, 9, 14]
    docs = spark.createDataFrame([(1, "abc"), (2, "defg"), (3, "h"), (2000, "x")], "doc_id long, text string")
    assert [tuple(r) for r in source.first_characters(docs, 5).orderBy("doc_id").collect()] == [(1, "abc"), (2, "de")]


def test_classifiers(spark):
    docs = spark.createDataFrame([(i, ("the good house " if i % 2 else "das gute Haus ") * 8, "en" if i % 2 else "de") for i in range(40)] + [(99, "欢迎来到我们的网站", "zh")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in classify.language(docs, docs.where("lang <> 'zh'")).collect()}
    assert all(found[i]["label"] == ("en" if i % 2 else "de") for i in range(40)) and found[99]["label"] == "zh"
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    assert all(r["label"] == ("wiki" if r["doc_id"] % 2 else "cc") for r in classify.quality(docs.where("doc_id < 40"), labels).collect())
    assert all(r["label"] == ("non-toxic" if r["doc_id"] % 2 else "toxic") for r in classify.toxic(docs.where("doc_id < 40"), labels).collect())
    assert one(spark, classify.nsfw(F.col("t")), t="XXX pics")["label"] == "nsfw" and one(spark, classify.nsfw(F.col("t")), t="a classic essex cocktail")["label"] == "non-nsfw"


def test_classifiers_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts, nothing to learn from; saved and loaded."""
    rows = [(i % 7 if i % 3 else None, t, g) for i, (t, g) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), (None, "en"), ("", None), ("中文 文本", None)] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = classify.language(docs, docs)
    assert found.count() == len(rows) and found.where("label = 'zh'").count() == 8
    nothing = classify.language(docs, docs.limit(0))
    assert nothing.count() == len(rows) and nothing.where("label is not null").count() == 8
    named = spark.createDataFrame([(i, ("good text here " if i % 2 else "bad spam there ") * 5) for i in range(40)], "doc_id long, text string")
    labels = named.select("doc_id", F.pmod("doc_id", F.lit(2)).alias("quality"))
    assert classify.quality(docs, labels.limit(0)).where("label is null and score = 0").count() == len(rows)
    fitted = classify.fit_binary(named, labels, "quality", ("cc", "wiki"))
    fitted.save(spark, str(tmp_path / "c"))
    again = classify.Classifier.load(spark, str(tmp_path / "c"))
    scored = again.scored(named.select("doc_id", classify.word_grams(F.col("text")).alias("grams"))).collect()
    assert all((r["label"] == "wiki") == (r["doc_id"] % 2 == 1) for r in scored)
    classify.Classifier(None, []).save(spark, str(tmp_path / "none"))
    assert classify.Classifier.load(spark, str(tmp_path / "none")).model is None

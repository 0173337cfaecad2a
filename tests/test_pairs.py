from millrace.plans import tokenizing


def test_pairs_are_counted_as_words(spark):
    """Digests are made of what has been counted, so they aren't shuffled."""
    found = tokenizing.next_token_pairs(spark, "/root/testdata/sf0.001")
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, x in enumerate(lines) if "Aggregate" in x)
    assert not any("md5" in x for x in lines[at + 1 :])
    assert found.count() == found.select("x_md5", "y_md5").distinct().count()

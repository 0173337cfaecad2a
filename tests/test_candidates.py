from millrace.plans import curation


def test_candidates_are_signed_once(spark):
    """Both sides of the join of bands read what was written, so no text is signed in it."""
    found = curation.lsh_candidates(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in found._jdf.queryExecution().toString()

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n not in ("minhash_signature",)])
def test_sql_has_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "events", "labels", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = entry.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    key = lambda r: tuple(str(x) for x in r)
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=key)
    for a, b in zip(rows, sorted(want.fetchall(), key=key), strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

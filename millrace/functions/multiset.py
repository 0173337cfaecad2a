"""Fingerprints of tables as multisets of rows: the same for the same rows in any order, however they are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes are added up modulo this.
MODULUS = 1 << 60


def _number(text: Column, salt: str) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(salt), text), "UTF-8")), 1, 15), 16, 10).cast("decimal(38,0)")


def row_text(columns: list[Column]) -> Column:
    """A row as text that differs for different rows: each value with its length before it, null told apart from empty."""
    each = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws(",", *each)


def fingerprint(columns: list[Column]) -> Column:
    """Aggregate: (n, a, b) of a group of rows, two sums of hashes modulo MODULUS. Groups with the same rows, as often each, have
    the same; others differ but for a chance of some 1 in 10^36. Sums are added up before the shuffle."""
    text = row_text(columns)
    total = lambda salt: F.pmod(F.coalesce(F.sum(_number(text, salt)), F.lit(0).cast("decimal(38,0)")), F.lit(MODULUS).cast("decimal(38,0)")).cast("long")
    return F.struct(F.count("*").alias("n"), total("a").alias("a"), total("b").alias("b"))


def _columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables have the same columns, in order, and the same rows, as often each; one pass over each, no join. Columns
    must be such that can be written as text."""
    if one.columns != two.columns:
        return False
    a, b = (df.agg(fingerprint(_columns(df)).alias("f")).first()["f"] for df in (one, two))
    return a == b

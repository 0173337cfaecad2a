"""Names of all queries outside the llm subpackage, with their SQL. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import curation, numeric, streams, tokenizing

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return curation.QUERIES | tokenizing.QUERIES | numeric.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return curation.SQL | tokenizing.SQL | numeric.SQL | streams.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked, filtered documents without repeated lines, by language."""
    return curation.curated_by_language(spark, sf_dir)

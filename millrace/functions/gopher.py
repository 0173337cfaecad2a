"""Rules on a document's words and lines. Words are runs of anything but white space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds, all inclusive."""

    # Fixed values
    min_words: int = 50
    max_words: int = 100_000
    min_mean_length: float = 3.0
    max_mean_length: float = 10.0
    max_ellipsis: float = 0.3
    min_alphabetic: float = 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mean_word_length(text: Column) -> Column:
    """Characters in words over the number of words; 0 without words."""
    n = n_words(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"\s+", "")) / n).otherwise(0.0)


def ellipsis_share(text: Column) -> Column:
    """Share of lines that end with three dots."""
    lines = F.split(text, "\n")
    return F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")))) / F.size(lines)


def alphabetic_share(text: Column) -> Column:
    """Share of words with a letter; 0 without words."""
    n = n_words(text)
    return F.when(n > 0, F.size(F.filter(words(text), lambda w: F.rlike(w, F.lit(r"\p{L}")))) / n).otherwise(0.0)


def rules(text: Column, limits: Limits = Limits()) -> dict[str, Column]:
    """Whether a text passes each rule; null never does."""
    passed = {
        "f1": n_words(text).between(limits.min_words, limits.max_words),
        "f2": mean_word_length(text).between(limits.min_mean_length, limits.max_mean_length),
        "f3": ellipsis_share(text) <= limits.max_ellipsis,
        "f4": alphabetic_share(text) >= limits.min_alphabetic,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in passed.items()}


def passes(text: Column, limits: Limits = Limits()) -> Column:
    """All rules at once."""
    f1, f2, f3, f4 = rules(text, limits).values()
    return f1 & f2 & f3 & f4

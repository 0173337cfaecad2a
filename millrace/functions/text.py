"""Splitting texts: special tokens, pre-tokens, bytes, words, shingles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pre-tokenisation pattern of the byte-level vocabularies
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"


def pretokens(text: Column) -> Column:
    """Pre-tokens in order; white space and letters are Unicode's."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


def split_special(text: Column, specials: list[str], keep: bool = True) -> Column:
    """Parts between special tokens, with (keep) or without the tokens; longer tokens win. Empty parts go."""
    if not specials:
        return F.filter(F.array(text), lambda p: p != "")
    any_ = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    if not keep:
        return F.filter(F.split(text, any_), lambda p: p != "")
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{any_})|.+?(?={any_}|$(?![\\r\\n]))"), F.lit(0))


def utf8(text: Column) -> Column:
    """The bytes of a text as an array of numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def normalised(text: Column) -> Column:
    """Lower case without punctuation, white space made one."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value found once a row, however often and wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct word n-grams of a normalised text; a shorter text is one shingle, an empty one none."""

    def grams(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(each)).otherwise(F.filter(F.array(F.array_join(words, " ")), lambda x: x != ""))

    return let(F.split(text, " "), grams)


def byte_signs() -> dict[int, str]:
    """Printable signs for all bytes: those that print stand for themselves, the others for signs from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def to_signs(data: Column) -> Column:
    """Binary to its printable signs."""
    signs = byte_signs()
    # translate() takes U+0000 for "delete", so that one goes by replace()
    text = F.replace(F.decode(data, "ISO-8859-1"), F.lit("\0"), F.lit(signs[0]))
    return F.translate(text, "".join(map(chr, range(1, 256))), "".join(signs[b] for b in range(1, 256)))


def from_signs(text: Column) -> Column:
    """Printable signs to binary."""
    signs = byte_signs()
    text = F.translate(text, "".join(signs[b] for b in range(1, 256)), "".join(map(chr, range(1, 256))))
    return F.encode(F.replace(text, F.lit(signs[0]), F.lit("\0")), "ISO-8859-1")

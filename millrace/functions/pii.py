"""Masks for personal data. Each returns a struct (text, n): the masked text and how many matches were replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masks are given, the patterns are shared with the SQL that checks them.
EMAIL_MASK = "|||EMAIL_ADDRESS|||"
PHONE_MASK = "|||PHONE_NUMBER|||"
IP_MASK = "|||IP_ADDRESS|||"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\(\d{3}\)|\b\d{3})[-. ]{0,2}\d{3}[-. ]?\d{4}\b"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"

MASKS = {"email": (EMAIL, EMAIL_MASK), "phone": (PHONE, PHONE_MASK), "ip": (IP, IP_MASK)}


def mask(text: Column, kind: str) -> Column:
    """Replace all matches of one kind (email, phone, ip). A mask that stands in the text already isn't counted."""
    pattern, with_ = MASKS[kind]
    return F.struct(F.regexp_replace(text, pattern, with_).alias("text"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("n"))


def mask_all(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then IP addresses; n is the number of all."""
    for pattern, with_ in MASKS.values():
        text = F.regexp_replace(text, pattern, with_)
    return text

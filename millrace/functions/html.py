"""Plain text of HTML pages."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import charset

_HIDDEN = {"script", "style", "head", "title", "noscript", "template", "textarea", "select", "iframe", "object"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class _Text(HTMLParser):
    """Gathers blocks of text; list items are marked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.now: list[str] = []
        self.item = False
        self.hidden: list[str] = []

    def flush(self) -> None:
        lines = [_SPACE.sub(" ", x).strip() for x in "".join(self.now).split("\0")]
        block = "\n".join(x for x in lines if x)
        if block:
            self.blocks.append((self.item, block))
            self.item = False
        self.now = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.hidden = [h for h in self.hidden if h != "head"]
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.append(tag)
            return
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag == "br":
            self.now.append("\0")
        elif tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                self.now.append(alt)
        elif tag in _BLOCK:
            self.flush()
            self.item = tag == "li"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag in _BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.now.append(data)


def extract_text(html: str | None) -> str | None:
    """Blocks with a blank line between them; items of a list follow each other, each behind a bullet."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser.flush()
    out: list[str] = []
    for k, (item, block) in enumerate(parser.blocks):
        if k:
            out.append("\n" if item and parser.blocks[k - 1][0] else "\n\n")
        out.append(f"  • {block}" if item else block)
    return "".join(out)


def decode_bytes(data: bytes | None) -> str | None:
    """As a byte-order mark says, else UTF-8 if that fits, else as the page itself says, else as its signs fit best; signs
    for what is broken."""
    if data is None:
        return None
    data = bytes(data)
    named = [e for mark, e in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")) if data.startswith(mark)]
    said = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", data[:4096])
    guess = [charset.detect(data)] if not named else []
    wide = [g for g in guess if g.startswith("utf-16")]  # which reads as UTF-8 with zeros
    for name in [*named, *wide, "utf-8", *([said[1].decode("ascii")] if said else []), *guess]:
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", errors="replace")


@F.pandas_udf(StringType())
def html_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Plain text of pages given as strings."""
    for html in pages:
        yield html.map(extract_text)


@F.pandas_udf(StringType())
def html_bytes_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Plain text of pages given as bytes."""
    for data in pages:
        yield data.map(lambda x: extract_text(decode_bytes(x)))


def html_text_plain(html: Column) -> Column:
    """A plainer form by patterns alone: scripts, styles, comments and tags go, five entities are read, spaces made one."""
    x = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f\v]+", " "))

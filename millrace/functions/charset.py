"""Which code page bytes without a declaration are in.

Every candidate that can read the bytes at all gives a text; the one whose signs beyond ASCII fit together best is taken. Letters
fit beside letters of their own script, in words that don't turn to capitals midway; controls, unassigned places and lines of
boxes don't fit anywhere. Double-byte pages are told by kana, hangul and the characters that their standards list first, which are
the common ones. Nothing is learned, so that languages which no corpus at hand has are told as well.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: In order of preference, where scores are equal.
SINGLE = ("cp1252", "cp1251", "koi8-r", "cp866", "cp1253", "mac_roman", "cp850")
DOUBLE = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")

_OTHER, _LATIN, _CYRILLIC, _GREEK, _KANA, _HAN, _HANGUL, _HALF, _QUOTE, _SYMBOL, _BAD = range(11)
_SCRIPTS = {"LATIN": _LATIN, "CYRILLIC": _CYRILLIC, "GREEK": _GREEK, "HIRAGANA": _KANA, "KATAKANA": _KANA, "KATAKANA-HIRAGANA": _KANA, "CJK": _HAN, "HANGUL": _HANGUL, "HALFWIDTH": _HALF}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, case) of every sign up to U+FFFF: case is 1 for small letters, 2 for capitals."""
    kind, case = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, np.int8)
    for code in range(1 << 16):
        c = chr(code)
        category = unicodedata.category(c)
        if category[0] == "L":
            kind[code] = _SCRIPTS.get(unicodedata.name(c, "").split(" ")[0], _OTHER)
            case[code] = {"Ll": 1, "Lu": 2}.get(category, 0)
        elif category in ("Cc", "Cn", "Co", "Cs") and c not in "\t\n\r\f\v\x1b":
            kind[code] = _BAD
        elif category[0] == "S":
            kind[code] = _SYMBOL
        elif category[0] == "P":
            kind[code] = _QUOTE
    kind[0xFFFD] = _BAD
    return kind, case


@cache
def _common(page: str) -> np.ndarray:
    """Which signs a double-byte page has among its first, common ones."""
    # fixed values: first bytes of the common level of each standard
    low, high = {"shift_jis": (0x88, 0x97), "euc_jp": (0xB0, 0xCF), "gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "euc_kr": (0xB0, 0xC8)}[page]
    out = np.zeros(1 << 16, bool)
    for lead in range(low, high + 1):
        for trail in range(0x40, 0xFF):
            try:
                sign = bytes([lead, trail]).decode(page)
            except UnicodeDecodeError:
                continue
            if len(sign) == 1 and ord(sign) < 1 << 16:
                out[ord(sign)] = True
    return out


def score(text: str, page: str) -> float:
    """How well a text's signs beyond ASCII fit together, for each byte that they come from, in all."""
    kinds, cases = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.minimum(codes, 0xFFFF)  # signs beyond are as those that are unassigned
    kind, case = kinds[codes], cases[codes]
    at = np.flatnonzero(codes >= 0x80)
    if not len(at):
        return 0.0
    around = np.r_[_QUOTE, kind, _QUOTE]
    before, after, k = around[at], around[at + 2], kind[at]
    letter = lambda x: (x >= _LATIN) & (x <= _HALF)
    capital_before = np.r_[0, case][at]
    points = np.zeros(len(at))
    alphabet = (k >= _LATIN) & (k <= _GREEK)
    points[alphabet] = 1.0
    # beside a letter of another script; a capital after a small letter
    strange = (letter(before) & (before != k)) | (letter(after) & (after != k))
    points[alphabet & strange] = -2.0
    points[alphabet & ~strange & (case[at] == 2) & (capital_before == 1)] = -2.0
    points[alphabet & ~strange & ~letter(before) & ~letter(after)] = 0.2
    points[(k == _SYMBOL) | (k == _OTHER)] = -1.0
    points[((k == _SYMBOL) | (k == _QUOTE)) & letter(before) & letter(after) & (codes[at] != 0x2019)] = -2.0
    points[k == _BAD] = -5.0
    points[k == _HALF] = -1.5
    if page in DOUBLE:
        common = _common(page)[codes[at]]
        points[k == _KANA] = 2.5
        points[k == _HAN] = np.where(common, 1.8, -2.0)[k == _HAN]
        points[k == _HANGUL] = np.where(common, 2.1, -2.0)[k == _HANGUL]
        points[alphabet] = -1.0
        points[(k == _QUOTE) & ~alphabet] = 0.5
    else:
        # marks beyond Latin-1 that text has, and others that only drawings have
        points[alphabet & (k == _LATIN) & (codes[at] > 0xFF) & (points > 0)] = 0.5
    return float(points.sum())


def detect(data: bytes) -> str:
    """The name of the code page of bytes that declare none: utf-8 where that fits, UTF-16 where every other byte is mostly zero,
    else the candidate of the best score."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) >= 4:
        zeros = [float((raw[i::2] == 0).mean()) for i in range(2)]
        if max(zeros) > 0.3 and min(zeros) < 0.1:
            return "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
    best, name = -np.inf, "utf-8"
    for page in ("utf-8", *SINGLE, *DOUBLE):
        try:
            text = data.decode(page)
        except UnicodeDecodeError:
            continue
        if page == "utf-8":
            return page
        if (points := score(text, page)) > best:
            best, name = points, page
    return name

"""Token ids of whole texts from a tokenizer file of the tokenizers library.

The file's normaliser and splitter work between white space only: no rule of theirs looks across a space, tab or
line end, and no added token contains one. So a text's ids are those of its runs between ASCII white space, one
after another, and a run that was met before need not be encoded again. Files for which that can't be told from
their definition are given whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import regex

from millrace.functions.text import byte_signs

#: Runs whose ids a worker keeps, twice over: the ones before are dropped as so many new ones have come. Longer runs
#: than MAX_RUN bytes aren't kept.
MAX_RUNS = 300_000
MAX_RUN = 64

#: Signs of the Latin blocks without spaces, controls and combining marks.
_PLAIN = re.compile("[!-~\u00a1-\u024f]+").fullmatch
# Fixed value: the splitter's pattern, as the tokenizer's file has it
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
#: Bytes as the signs that stand for them in byte-level vocabularies.
_BYTE_SIGNS = byte_signs()

_loaded: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file, one for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _splits_at_spaces(definition: dict) -> bool:
    """Whether the definition is of the kind described above: NFC, white space made one, lower case; a splitter that
    drops what lies between runs of letters, single digits and runs of other signs; BPE with an end-of-word suffix."""
    # the pattern and the names below are fixed values of the files' format
    norm, pre, model = (definition.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = norm.get("normalizers", [])
    split, *rest = pre.get("pretokenizers") or [{}]
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern") == {"Regex": r"\s+"}
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and split.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and [(r.get("type"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False)]
        and model.get("type") == "BPE"
        and not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") or t["lstrip"] or t["rstrip"] for t in definition.get("added_tokens", []))
    )


class _Runs(dict):
    """Ids by run, made where they are missing. older: those of the time before."""

    def __init__(self, make, older: dict):
        self.make, self.older = make, dict(older)

    def __missing__(self, run: bytes) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            ids = self.make(run)
        if len(run) <= MAX_RUN:
            self[run] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        definition = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model
        self.by_run = _splits_at_spaces(definition)
        added = [re.escape(t["content"].encode("utf-8")) for t in definition.get("added_tokens", [])]
        self.added = re.compile(b"|".join(added) if added else b"(?!)").search
        self.pieces: dict[bytes, bytes] = {}
        self.known = _Runs(self._run, {})

    def rest(self) -> None:
        """Called where a task ends: the worker waits for the next one, so let go of what was met longer ago."""
        self.known.older = {}

    def forget(self) -> None:
        """Called where a task of a stage among others ends: the worker goes on to other work, so let go of all that was met."""
        self.known, self.pieces = _Runs(self._run, {}), {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: bytes) -> bytes:
        """Ids of a run between white space. Where no sign is a mark that could combine with another, the normaliser
        is lower case alone; the pieces then go to the library's model straight away."""
        text = run.decode("utf-8")
        if not _PLAIN(text) or self.added(run):
            return self._whole(text)
        pieces = _PIECE(text.lower())
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            as_bytes = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(_BYTE_SIGNS)
            tokens = self.model.tokenize(as_bytes)
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            if len(piece) <= MAX_RUN:
                if len(self.pieces) >= MAX_RUNS:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (none for null) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_run:
            return self._whole(text)
        ids = b"".join(map(self.known.__getitem__, text.encode("utf-8").split()))
        if len(self.known) >= MAX_RUNS:
            self.known = _Runs(self._run, self.known)
        return ids

"""Chat formatting with a grammar round trip.

A conversation is written as one string in which control strings mark where turns begin and end. The grammar is

    conversation = { turn }
    turn         = open(role) text close(role)  |  other_open role other_middle text other_close

with a pair of control strings for each known role and three for all other roles. A text may hold control strings
itself. So every turn is first written as it is, the result is parsed by the grammar alone, and what the parser
recovers is compared with the source: turns that differ are written again with their text (or role) escaped, until
the parser gives back exactly the source. A control string, or one that looks escaped already, is escaped by a backslash
after its first sign; the parser takes one backslash off each of them. That is reversible, and ordinary texts stay
as they are.

The loss mask is a list of spans of the string: the texts of the roles that are learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.ordering import free_names

from .common import Scratch, values

#: A turn: role, text.
Turn = tuple[str, str]


class NotInGrammar(ValueError):
    """The string is no conversation."""


@dataclass(frozen=True)
class Template:
    """Control strings by role, those for other roles, and the roles that are learned from."""

    pairs: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)
    _parts: tuple = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        controls = sorted({c for _, *pair in self.pairs for c in pair} | set(self.other))
        if len(controls) != 2 * len(self.pairs) + 3 or any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("control strings must differ, have two signs or more and no backslash")
        for a in controls:
            for b in controls:
                # else the end of a text could grow into another control string with what follows it
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise ValueError(f"{b} could begin within {a}")
        alike = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in controls)
        escaped = "|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in controls)
        parts = (re.compile("|".join(map(re.escape, controls))), re.compile(alike), re.compile(escaped), {r: (a, b) for r, a, b in self.pairs}, {a: (r, b) for r, a, b in self.pairs})
        object.__setattr__(self, "_parts", parts)

    def __reduce__(self):
        return Template, (self.pairs, self.other, self.learned)

    def escape(self, text: str) -> str:
        """text with a backslash more after the first sign of all that looks like a control string."""
        return self._parts[1].sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        """The opposite of escape."""
        return self._parts[2].sub(lambda m: m[0][0] + m[0][2:], text)

    def write(self, role: str, text: str) -> tuple[str, int]:
        """A turn as it stands in the string, and where its text begins there."""
        if role in self._parts[3]:
            open_, close = self._parts[3][role]
            return f"{open_}{text}{close}", len(open_)
        open_, middle, close = self.other
        return f"{open_}{role}{middle}{text}{close}", len(open_) + len(role) + len(middle)

    def parse(self, string: str) -> list[tuple[str, int, int]]:
        """(role, start, end) of every turn: where its text stands in the string, still escaped. Raises NotInGrammar."""
        control, _, _, _, opens = self._parts
        out, at = [], 0
        while at < len(string):
            m = control.match(string, at)
            if m is None:
                raise NotInGrammar(f"no turn begins at {at}")
            if m[0] in opens:
                role, close = opens[m[0]]
                start = m.end()
            elif m[0] == self.other[0]:
                end = control.search(string, m.end())
                if end is None or end[0] != self.other[1]:
                    raise NotInGrammar(f"the role at {m.end()} has no end")
                role, start, close = self.unescape(string[m.end() : end.start()]), end.end(), self.other[2]
            else:
                raise NotInGrammar(f"{m[0]} at {at} begins no turn")
            end = control.search(string, start)
            if end is None or end[0] != close:
                raise NotInGrammar(f"the turn at {at} doesn't end with {close}")
            out.append((role, start, end.start()))
            at = end.end()
        return out

    def turns(self, string: str) -> list[Turn]:
        return [(role, self.unescape(string[a:b])) for role, a, b in self.parse(string)]

    def render(self, turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
        """The string of these turns, which parse() gives back exactly, and the spans that are learned from."""
        written = [(r, t) for r, t in turns]
        for _ in range(2):  # as they are; with those escaped that didn't come back
            pieces, spans, at = [], [], 0
            for (role, text), (source, _) in zip(written, turns, strict=True):
                piece, begin = self.write(role, text)
                pieces.append(piece)
                if source in self.learned:
                    spans.append((at + begin, at + begin + len(text)))
                at += len(piece)
            string = "".join(pieces)
            try:
                if self.turns(string) == turns:
                    return string, spans
            except NotInGrammar:
                pass
            written = [w if self._comes_back(piece, turn) else (turn[0] if turn[0] in self._parts[3] else self.escape(turn[0]), self.escape(turn[1])) for w, piece, turn in zip(written, pieces, turns, strict=True)]
        raise AssertionError("escaped turns come back, since no control string can begin within another")

    def _comes_back(self, piece: str, turn: Turn) -> bool:
        try:
            return self.turns(piece) == [turn]
        except NotInGrammar:
            return False


#: Turns, and signs of their texts, of one row of the output at most (but for a single longer text).
MAX_TURNS, MAX_SIGNS = 512, 1 << 20

SCHEMA = "conv_id long, segment long, n_turns long, formatted string, learned array<struct<start:long,end:long>>, whole boolean"


def format_rows(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The strings of conversations (conv_id, turn, role, text), turns in order.

    Returns conv_id, segment, n_turns, formatted, learned (spans of code points in formatted that are learned from), whole.
    A row is a conversation (whole is true), or a segment of one: conversations of more than MAX_TURNS turns or
    MAX_SIGNS signs are written in several rows, whose strings follow one another in the order of segment. Each string is
    in the grammar by itself.

    Turns are dealt out in ranges of (conv_id, turn), so a conversation of any length is worked on by many tasks. Null
    texts and roles are empty. Turns without a number come first; those of one number are in the order of their roles, then of
    a hash of their texts. A null conv_id is a conversation of its own. Repeated rows are turns each for itself. An empty
    table gives no row.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = free_names(1, rows)[0]
    order = ["conv_id", "turn", "role", key]
    dealt = rows.withColumn(key, F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop(key)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 33
        now, turns, size, begun, ready = object(), [], 0, 0, []

        def close(end: bool) -> None:
            """Write the open turns; end: no other turn of the conversation is in this task."""
            nonlocal segment, turns, size
            string, spans = template.render(turns)
            # the first and the last conversation of a task may go on in the tasks beside it
            alone = end and begun == segment and segment & ((1 << 33) - 1) > 0
            ready.append((now, segment, len(turns), string, [{"start": a, "end": b} for a, b in spans], alone))
            segment, turns, size = segment + 1, [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) or [()] * 6
            ready.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for conv, role, text in zip(values(b.column(0)), values(b.column(2)), values(b.column(3)), strict=True):
                if turns and (conv != now or len(turns) >= MAX_TURNS or size + len(text) > MAX_SIGNS):
                    close(conv != now)
                if conv != now:
                    begun = segment
                now = conv
                turns.append((role, text))
                size += len(text)
            if len(ready) >= 100:
                yield batch()
        if turns:
            close(False)
        yield batch()

    return dealt.mapInArrow(go, SCHEMA)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What stands in the strings of format_rows(), read by the grammar alone: conv_id, n_turns, turns_sha256 (role, line end,
    text, line end of each turn), loss_chars and loss_sha256 (the texts in the learned spans, unescaped, one after another),
    formatted_chars.

    Whole conversations are read where they lie. Segments of others are brought together in order; since a digest takes in
    one sign after another, one task reads a conversation's segments, a batch at a time.
    """
    columns = ["conv_id", "segment", "n_turns", "formatted", "learned"]
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def read(conversation: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, out = object(), None, []

            def done() -> None:
                if state is not None:
                    conv, n, turns, chars, loss, signs = state
                    out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), signs))

            def batch() -> pa.RecordBatch:
                found = list(zip(*out, strict=True)) or [()] * 6
                out.clear()
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, types, strict=True)], [c.split()[0] for c in kinds.split(", ")])

            for b in batches:
                for conv, string, spans in zip(values(b.column(0)), values(b.column(3)), values(b.column(4)), strict=True):
                    if state is None or conversation or conv != now:
                        done()
                        state, now = [conv, 0, sha256(), 0, sha256(), 0], conv
                    for role, text in template.turns(string):
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
                    for s in spans:
                        text = template.unescape(string[s["start"] : s["end"]])
                        state[3] += len(text)
                        state[4].update(text.encode())
                    state[5] += len(string)
                yield batch()
            done()
            yield batch()

        return go

    alone = formatted.where("whole").select(*columns).mapInArrow(read(True), kinds)
    parts = formatted.where("not whole").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return alone.unionByName(parts.mapInArrow(read(False), kinds))


def round_trip(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """digests() of the strings of conversations as read back from where they were written."""
    scratch = Scratch(conversations.sparkSession, "chat")
    return digests(scratch.table(format_rows(conversations, template), "formatted"), template)

"""Streams of raw chunks of text, cut anywhere: a stream's ids are those of its whole text, however it comes in pieces.

Each stream (a file, a connection) has a state: what of its text can't be encoded yet, since what follows may still change how it
is split, and chunks that came before their turn. The state is kept by Spark beside the query's checkpoint, so a query
that is started again goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

if TYPE_CHECKING:
    from millrace.operators.bpe import Codec

OUT = "stream string, part long, ids array<int>"
STATE = "rest string, next long, part long, early string"


def settled(codec: Codec, text: str) -> int:
    """How much of a text is split in the same way whatever follows it.

    What may be the begin of a special token waits for its end. Before it, the last two words wait: the last may grow, and both
    together may become one, such as the sign and the letters of a contraction.
    """
    end = len(text)
    for s in codec.specials:
        for n in range(min(len(s) - 1, len(text)), 0, -1):
            if text.endswith(s[:n]):
                end = min(end, len(text) - n)
                break
    begin = 0
    if codec.split:
        for m in codec.split.finditer(text, 0, end):
            begin = m.end()
    words = [m.start() for m in codec.pattern.finditer(text, begin, end)]
    return words[-2] if len(words) > 2 else begin


def encode_chunks(chunks: DataFrame, codec: Codec) -> DataFrame:
    """stream, part (from 0), ids of a streaming DataFrame of chunks (stream, seq from 0, chunk). A null chunk is the end of its
    stream: only then is its last word encoded. Chunks may come in any order and more than once; the parts of a stream, in order, are
    its ids. Chunks after the end are left out."""

    def go(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, due, part, early = state.get if state.exists else ("", 0, 0, "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for f in frames:
            for seq, chunk in zip(f["seq"].tolist(), f["chunk"].tolist(), strict=True):
                if due >= 0 and seq >= due:
                    waiting.setdefault(seq, None if chunk is None or chunk != chunk else chunk)
        ended, pieces = False, [rest]
        while due >= 0 and due in waiting:
            chunk = waiting.pop(due)
            due += 1
            if chunk is None:
                ended = True
                break
            pieces.append(chunk)
        rest = "".join(pieces)
        n = len(rest) if ended else settled(codec, rest)
        ids, rest = codec.encode(rest[:n]), rest[n:]
        if ended:
            due, waiting = -1, {}
        state.update((rest, due, part + bool(ids), json.dumps(waiting)))
        if ids:
            yield pd.DataFrame({"stream": [key[0]], "part": [part], "ids": [ids]})

    return chunks.groupBy("stream").applyInPandasWithState(go, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

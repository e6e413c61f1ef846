"""Chat formatting by token-level assembly.

Role names and contents are encoded segment by segment as ordinary text, and
the reserved ids of the turn marks are spliced in between, so nothing that a
text says can become a mark. A conversation, in the order of its turns, is

    BEGIN <role> "\\n" <content> END  for each turn, then STOP,

with BEGIN and END the two ids behind the vocabulary and STOP the one before
them. Trained on are the content and the END of assistant turns: +1 where such
a span begins and -1 behind its end, and the mask is the prefix sum.

Control strings ("<|" name "|>", the name of any length and any characters but
angle brackets) that occur in a content or a role are escaped by a backslash
before the bar, and one more where there are some already, so that text decoded
from the ids can't be mistaken for a mark and escaping is undone exactly by
unescape().

Results for special cases:
* null or empty text: a turn without content; null role: an empty role name;
* null turn: before all others; turns of equal number: by role, then text;
* repeated rows: each is a turn; null conv_id: left out (turns of which talk?);
* roles: any, their white space as single spaces; only "assistant" is trained on;
* very long texts: encoded whole, runs of one character too;
* an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.tokens import VOCABULARY, Encoder, encoder, shipped

_CONTROL = re.compile(r"<(\\*)\|(?=[^<>]*\|>)")
_ESCAPED = re.compile(r"<\\(\\*)\|(?=[^<>]*\|>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def reserved(size: int) -> tuple[int, int, int]:
    """BEGIN, END and STOP for a vocabulary of `size` ids."""
    return size + 1, size + 2, size


def assemble(turns: list[tuple[str | None, str | None]], own: Encoder) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, mask, escaped contents) of a conversation."""
    begin, end, stop = reserved(own.size)
    mark = lambda x: np.array([x], np.int32)
    parts, at, edges, escaped = [], 0, [], 0
    for role, text in turns:
        content = escape(text or "")
        escaped += content != (text or "")
        head = np.frombuffer(own.encode(escape(" ".join((role or "").split())) + "\n"), own.dtype)
        body = np.frombuffer(own.encode(content), own.dtype) if content else np.zeros(0, own.dtype)
        parts += [mark(begin), head, body, mark(end)]
        start = at + 1 + len(head)
        at = start + len(body) + 1
        if role == "assistant":
            edges += [(start, 1), (at, -1)]
    parts.append(mark(stop))
    ids = np.concatenate([p.astype(np.int32) for p in parts])
    steps = np.zeros(len(ids) + 1, np.int8)
    for k, v in edges:
        steps[k] += v
    return ids, np.cumsum(steps[:-1], dtype=np.int8), escaped


def _format(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        for batch in batches:
            made = [assemble([(t["role"], t["text"]) for t in turns], own) for turns in batch.column(1).to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(m[0]) for m in made], dtype=np.int64))).astype(np.int32))
            ids = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int32)
            mask = np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.int8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in batch.column(1)], pa.int32()),
                    pa.array([m[2] for m in made], pa.int32()),
                    pa.array([int(m[1].sum()) for m in made], pa.int32()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    pa.ListArray.from_arrays(offsets, pa.array(mask)),
                ],
                names=["conv_id", "n_turns", "n_escaped", "n_trained", "ids", "mask"],
            )

    return run


def format_chats(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, n_escaped, n_trained, ids, mask), a row a conversation."""
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").where("conv_id is not null")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    out = "conv_id bigint, n_turns int, n_escaped int, n_trained int, ids array<int>, mask array<tinyint>"
    return turns.mapInArrow(_format(shipped(conversations.sparkSession, vocabulary)), out)

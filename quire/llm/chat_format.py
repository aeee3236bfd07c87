"""Operator 7: chat formatting by incremental black-box rendering.

A template is any callable from a list of (role, text) turns to a string.  The operator renders
the prefixes of 1, 2, ... turns and compares consecutive outputs: what both share is settled, so
the new turn's span is what the longer output adds.  A template whose longer output does not keep
what the shorter one settled rewrites history; such conversations are flagged and their spans are
those of the last output in which the turn was whole.  Where a turn's text lies inside its span is
found the same way, by rendering the turn with two probe texts and comparing the outputs.

``render_turns`` is the default template.  It writes ``### role: text</turn>`` per turn and
escapes, with a backslash, the backslash and the control strings inside roles and texts, so that
``parse_turns`` reads every turn back exactly.

Null roles and texts are empty.  Turns are ordered by turn number (nulls first), role and text;
repeated rows stay.  Rows with a null conversation id form a conversation of their own.  Only the
four named columns are read.  A conversation is streamed in order of its turns and kept in memory
only as long as it lasts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings of the default template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"

_SPECIAL = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
PROBES = ("\u0001", "\u0002")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turns(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{escape(role)}{AFTER_ROLE}{escape(text)}{CLOSE}" for role, text in turns)


def parse_turns(formatted: str) -> list[Turn]:
    """The turns of a string that ``render_turns`` made."""
    found, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def locate(turns: list[Turn], template: Template, masked: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The rendering, each turn's span, the text spans of turns by ``masked``, and whether history was rewritten."""
    before = template([])
    tail = 0  # length of what the template puts at the end of every prefix, such as an end mark
    if turns and before:
        first_output = template(turns[:1])
        if not first_output.startswith(before):
            tail = len(before) if first_output.endswith(before) else min(len(before) - shared(before, first_output), shared(before[::-1], first_output[::-1]))
    spans: list[tuple[int, int]] = []
    texts: list[tuple[int, int]] = []
    rewritten = False
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        kept, settled = shared(before, now), len(before) - tail
        rewritten |= kept < settled
        spans.append((min(kept, settled), len(now) - tail))
        if role == masked:
            one, two = (template([*turns[:k], (role, probe)]) for probe in PROBES)
            head = shared(one, two)
            foot = shared(one[head + 1 :][::-1], two[head + 1 :][::-1])
            texts.append((head, len(now) - foot))
        before = now
    return before, spans, texts, rewritten


def format_chats(
    df: DataFrame,
    template: Template = render_turns,
    masked: str = "assistant",
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows (conv_id, formatted, turn_spans, loss_spans, rewritten), one per conversation.

    Spans are pairs of character offsets into ``formatted``; ``loss_spans`` are the texts of the
    masked role as the template wrote them.
    """
    fields = [df.schema[conversation]]
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))
    fields += [T.StructField("formatted", T.StringType()), T.StructField("turn_spans", spans), T.StructField("loss_spans", spans), T.StructField("rewritten", T.BooleanType())]
    names = [f.name for f in fields]

    def finish(key, turns: list[Turn]) -> tuple:
        out, every, loss, rewritten = locate(turns, template, masked)
        return key, out, [{"first": a, "past": b} for a, b in every], [{"first": a, "past": b} for a, b in loss], rewritten

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, turns, done = None, [], []
        for frame in frames:
            for null, value, who, what in zip(frame["lost"], frame["key"], frame["role"], frame["text"], strict=True):
                now = None if null else int(value) if whole else value
                if turns and now != key:
                    done.append(finish(key, turns))
                    turns = []
                    if len(done) >= 1000:
                        yield table(done)
                        done = []
                key = now
                turns.append((who, what))
        if turns:
            done.append(finish(key, turns))
        if done:
            yield table(done)

    def table(done: list[tuple]) -> pd.DataFrame:
        keys = pd.array([d[0] for d in done], dtype="Int64" if whole else "object")
        return pd.DataFrame({names[0]: keys, **{n: [d[k] for d in done] for k, n in enumerate(names[1:], 1)}})

    whole = isinstance(fields[0].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    rows = df.select(
        (F.coalesce(F.col(conversation), F.lit(0)) if whole else F.col(conversation)).alias("key"),
        F.col(conversation).isNull().alias("lost"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("lost", "key").sortWithinPartitions("lost", "key", "turn", "role", "text")
    return ordered.mapInPandas(run, T.StructType(fields))


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the turns read back from ``formatted`` and the text under its loss mask amount to."""
    import hashlib

    key = formatted.schema[conversation]
    schema = T.StructType([key, *(T.StructField(n, k) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("rewritten", T.BooleanType())))])

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for out, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(out)
                under = "".join(unescape(out[s["first"] : s["past"]]) for s in loss)
                rows.append((len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(under), sha(under), len(out)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], schema.fieldNames())

    return formatted.select(conversation, "formatted", "loss_spans", "rewritten").mapInArrow(run, schema)

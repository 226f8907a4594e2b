"""Conversations to training examples: every assistant turn becomes one, with all turns before it.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash is
doubled, and one is put after the first character of every control string (those of the template
and of common tokenizers), so no control string survives in a text and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wareseek.llm.common import slices

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First characters of control strings, each followed by what makes it one.
_CONTROL = re.compile(r"<(?=\||s>|/s>|unk>|pad>|mask>|<SYS>>|</SYS>>)|\[(?=/?INST\]|CLS\]|SEP\]|PAD\]|MASK\])", re.I)
_WRITTEN_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_CHARS_IN_BATCH = 4 << 20
TARGET_ROLE = "assistant"

_EXAMPLE = T.StructType(
    [
        T.StructField("example", T.LongType()),
        T.StructField("turns", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _expanded(batches: Iterator[pa.RecordBatch], key: str, kind: pa.DataType, role: str) -> Iterator[pa.RecordBatch]:
    """Examples of adjacent, ordered turns. Holds one conversation's text at a time."""
    keys: list = []
    rows: list[tuple] = []
    size = 0
    parts: list[str] = []
    current, number, turns, waiting, begun = None, 0, 0, False, False

    def batch() -> pa.RecordBatch:
        nonlocal keys, rows, size
        columns = list(zip(*rows))
        arrays = [pa.array(keys, kind)]
        arrays += [pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(columns)]
        keys, rows, size = [], [], 0
        return pa.RecordBatch.from_arrays(arrays, [key, *_EXAMPLE.fieldNames()])

    def add(text: str, start: int, end: int) -> None:
        nonlocal number, size, waiting
        keys.append(current)
        rows.append((number, turns, text, start, end))
        number, size, waiting = number + 1, size + len(text), False

    for part in slices(batches, 1024):
        for conv, who, text in zip(*(part.column(c).to_pylist() for c in (key, "role", "text"))):
            if not begun or conv != current:
                if waiting:
                    add("".join(parts), 0, 0)
                current, begun, number, turns, parts = conv, True, 0, 0, []
            who, text = who or "", escape(text or "")
            head = f"{TURN}{escape(who)}{TEXT}"
            parts = ["".join(parts)] if len(parts) > 64 else parts
            parts += [head, text, END]
            turns, waiting = turns + 1, True
            if who == role:
                whole = "".join(parts)
                parts = [whole]
                end = len(whole) - len(END)
                add(whole, end - len(text), end)
            if size >= _CHARS_IN_BATCH:
                yield batch()
    if waiting:
        add("".join(parts), 0, 0)
    if rows:
        yield batch()


def expand(turns: DataFrame, key: str = "conv_id", role: str = TARGET_ROLE) -> DataFrame:
    """One row for every turn of ``role``: all turns up to it as ``text``, with the loss on it alone.

    Needs the columns ``key``, ``turn``, ``role``, ``text``; any others are left out. The result
    has ``example`` (from 0), ``turns`` (those in the text) and the loss range in code points,
    ``loss_start`` to ``loss_end`` exclusive. Turns after the last target, or a conversation
    without one, end in a further row with an empty range, so that no turn is lost. Rows of a
    conversation are adjacent and in order.

    Turns are ordered by ``turn`` (nulls first), ties by role and text; repeated rows are turns of
    their own. Null roles and texts are empty. Rows with a null key are one conversation. An empty
    table gives no rows. The texts of a conversation grow with the square of its turns, as every
    target repeats what precedes it; only one conversation at a time is held, in sorted rows.
    """
    kind = turns.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *_EXAMPLE])
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    ordered = (
        turns.select(key, "turn", "role", "text")
        .repartition(key)
        .sortWithinPartitions(key, "turn", "role", "text")
        .select(key, "role", "text")
    )
    return ordered.mapInArrow(lambda batches: _expanded(batches, key, arrow, role), schema)


def turns_of(text: str) -> list[tuple[str, str]]:
    """The roles and texts that a formatted text was made of."""
    return [(unescape(m[1]), unescape(m[2])) for m in _WRITTEN_TURN.finditer(text)]


def _digests(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    current = last = loss = None
    chars = kept = examples = 0
    kinds = (None, *[pa.int64()] * 2, pa.string(), pa.int64(), pa.string(), pa.int64())
    names = (key, "n_examples", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kind = None

    def finish() -> None:
        turns = turns_of(last)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        done.append((current, examples, len(turns), whole.hexdigest(), kept, loss.hexdigest(), chars))

    def batch() -> pa.RecordBatch:
        nonlocal done
        arrays = [pa.array(c, t or kind) for c, t in zip(zip(*done), kinds)]
        done = []
        return pa.RecordBatch.from_arrays(arrays, list(names))

    for part in slices(batches, 64):
        kind = part.column(key).type
        columns = (key, "example", "text", "loss_start", "loss_end")
        for conv, number, text, start, end in zip(*(part.column(c).to_pylist() for c in columns)):
            if number == 0:
                if last is not None:
                    finish()
                current, loss, chars, kept, examples = conv, hashlib.sha256(), 0, 0, 0
            trained = unescape(text[start:end])
            loss.update(trained.encode())
            last, chars, kept, examples = text, chars + len(text), kept + len(trained), examples + 1
        if len(done) > 1000:
            yield batch()
    if last is not None:
        finish()
        yield batch()


def digests(examples: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the examples hold, read back from their texts: one row for each conversation.

    Takes the rows as ``expand`` leaves them, a conversation's adjacent and in order, so nothing
    is shuffled again.
    """
    schema = T.StructType(
        [
            examples.schema[key],
            *[T.StructField(n, T.LongType()) for n in ("n_examples", "n_turns")],
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    return examples.mapInArrow(lambda batches: _digests(batches, key), schema)

"""Exact token counts of every prefix of a text, from one pass over it.

Byte-pair encodings have a prefix property: the encoding of a text without its last token is the
encoding of the shorter text. So the encoding of each prefix is known from one number, its last
token, and that token is the only vocabulary piece that ends there and may follow the last token
of the prefix before it. ``count[i] = count[i - len(token)] + 1`` then gives the exact count at
every code point, and questions about budgets and cuts need no further encoding.

Pieces never contain a space mark after another character, nor a line end, so texts fall into
segments (a word with the spaces before it) that are encoded independently. A segment's counts
are kept in a table of bounded size, as words repeat.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame, types as T

from wareseek.llm.common import slices

SPACE_MARK = "▁"
_ROWS = 256
_TABLE_SEGMENTS = 500_000
_LONGEST_KEPT = 64


class PrefixTable(dict):
    """Counts at each character of a segment, found when first asked for, as int32 bytes."""

    def __init__(self, processor):
        super().__init__()
        self._encode = processor.encode
        self._names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        self._pair: dict[int, bool] = {}
        # A keyword tree of the pieces. ends[node]: the pieces that end there, longest first, as
        # (id, length); the tree's fallback links fill it, and transitions are added when first used.
        self._next: list[dict[str, int]] = [{}]
        self._ends: list[tuple[tuple[int, int], ...]] = [()]
        for i, piece in enumerate(self._names):
            if processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i):
                continue
            node = 0
            for char in piece:
                node = self._next[node].setdefault(char, len(self._next))
                if node == len(self._next):
                    self._next.append({})
                    self._ends.append(())
            self._ends[node] = ((i, len(piece)),)
        self._back = [0] * len(self._next)
        level = list(self._next[0].values())
        for node in level:  # grows while it is walked: breadth first
            for char, child in self._next[node].items():
                back = self._back[node]
                while back and char not in self._next[back]:
                    back = self._back[back]
                self._back[child] = self._next[back].get(char, 0)
                self._ends[child] += self._ends[self._back[child]]
                level.append(child)

    def __missing__(self, segment: str) -> bytes:
        counts = self.counts(segment)
        if len(segment) <= _LONGEST_KEPT:
            self[segment] = counts
        return counts

    def _step(self, node: int, char: str) -> int:
        start = node
        while node and char not in self._next[node]:
            node = self._back[node]
        node = self._next[node].get(char, 0)
        if node:
            self._next[start][char] = node
        return node

    def _follows(self, key: int) -> bool:
        """Whether encoding two joined pieces leaves them as they are."""
        first, second = key >> 32, key & 0xFFFFFFFF
        # A line end is encoded by itself, so it keeps the leading space mark away from the pair.
        encoded = self._encode(f"\n{self._names[first]}{self._names[second]}")
        found = self._pair[key] = encoded[2:] == [first, second]
        return found

    def counts(self, segment: str) -> bytes:
        step, ends, pair = self._next, self._ends, self._pair
        last, count = [-1], [0]
        node = end = 0
        for char in segment:
            node = step[node].get(char) or self._step(node, char)
            end += 1
            for piece, length in ends[node]:
                before = last[end - length]
                if before < 0:
                    break
                key = before << 32 | piece
                fits = pair.get(key)
                if fits or fits is None and self._follows(key):
                    break
            else:  # not in the vocabulary: one token for each byte, and nothing merges with it
                last.append(-1)
                count.append(count[-1] + len(char.encode()))
                continue
            last.append(piece)
            count.append(count[end - length] + 1)
        return array("i", count[1:]).tobytes()

    def trim(self) -> None:
        if len(self) > _TABLE_SEGMENTS:
            self.clear()
        if len(self._pair) > 2 * _TABLE_SEGMENTS:
            self._pair.clear()


SEGMENT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")


def prefix_counts(text: str, table: PrefixTable) -> np.ndarray:
    """The number of tokens of each non-empty prefix of ``text``."""
    if not text:
        return np.empty(0, dtype=np.int32)
    segments = SEGMENT.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
    counts = np.frombuffer(b"".join([table[s] for s in segments]), dtype=np.int32).copy()
    lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    totals = counts[np.cumsum(lengths) - 1]
    counts += np.repeat(np.cumsum(totals, dtype=np.int32) - totals, lengths)
    return counts[1:]


def _load(model_file: str) -> PrefixTable:
    """The table of this Python worker, which keeps it for its later tasks."""
    import sentencepiece

    key = f"prefix counts of {model_file}"
    table = ModelCache.get(key)
    if table is None:
        table = PrefixTable(sentencepiece.SentencePieceProcessor(model_file=model_file))
        ModelCache.add(key, table)
    return table


def _counter(
    model_file: str, text: str, budget: int | None, names: tuple[str, ...]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _load(model_file)
        for batch in slices(batches, _ROWS):
            table.trim()
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts = [prefix_counts(t, table) for t in texts]
            sizes = np.fromiter(map(len, counts), dtype=np.int32, count=len(counts))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            made = [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([int(c[-1]) if len(c) else 0 for c in counts], pa.int64()),
                pa.ListArray.from_arrays(offsets, np.concatenate(counts)),
            ]
            if budget is not None:
                kept = [int(np.flatnonzero(c <= budget)[-1:].sum() + 1) if len(c) and (c <= budget).any() else 0 for c in counts]
                made.append(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return run


def count_tokens(
    docs: DataFrame,
    model_file: str,
    text: str = "text",
    budget: int | None = None,
    prefix: str = "",
) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``prefix_tokens`` to every row.

    ``prefix_tokens[k - 1]`` is the exact token count of the first k code points. With a
    ``budget``, ``fits_chars`` is the length of the longest prefix within it. Counts can fall as
    a prefix grows (two tokens become one), so the longest fit is searched over all prefixes.

    ``model_file`` is a byte-pair model whose pieces hold space marks only at their start; it must
    have the same path on all executors. A null or empty text has no tokens and an empty array.
    Special strings in texts are ordinary text. Rows are handled one by one: repeated rows and
    empty tables need no care, and other columns pass unchanged. ``prefix`` is put before the
    added names where they would clash with columns of the input, which is refused otherwise.
    """
    names = tuple(prefix + n for n in ("n_bytes", "n_tokens", "prefix_tokens", "fits_chars")[: 3 + (budget is not None)])
    taken = set(names) & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already; set prefix")
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.IntegerType()), T.LongType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    return docs.mapInArrow(_counter(model_file, text, budget, names), schema)

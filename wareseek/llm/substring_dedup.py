"""Removal of word spans that an earlier document already holds, by suffix automata.

A span counts from ``window`` words on: every word goes that lies in a window of so many words
which also starts in a document with a smaller id.

All documents are each other's reference, so the reference is cut into shards and documents
stream only through the shards that can hold their windows. Among the runs of ``GRAM`` words in a
window, the one with the least hash is the window's anchor; equal windows have equal anchors.
Neighbouring windows with one anchor form a passage. Passages met in one document only are done
with. Of equal passages the smallest id keeps its copy, the others lose it whole. What is left,
unequal passages around one anchor, is a shard: a suffix automaton over the passages of smaller
ids, through which each passage streams for its matching statistics. Where the longest match that
ends at a word has ``window`` words or more, that window is known.

Shards of frequent anchors hold ``SHARD_PASSAGES`` passages at most, and every passage of the
anchor streams through each of them, so an automaton's memory is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wareseek.llm.common import WORD, mixed, slices
from wareseek.storage import materialise

WINDOW = 50
GRAM = 16
SHARD_PASSAGES = 1000
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROWS = 256
_KNOWN_WORDS = 300_000


class WordHashes(dict):
    """64-bit hashes of words, the frequent ones kept."""

    def __init__(self):
        super().__init__()
        self._find = re.compile(WORD).findall

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value

    def words(self, text: str) -> list[str]:
        return self._find(text)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        return np.fromiter((self[w] for w in words), dtype=np.uint64, count=len(words))


def passages(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, digest, start and length of each passage of a text's word hashes."""
    n = len(hashes)
    if n < window:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    # Sums of hash * base^place make the digest of any run a difference, moved back to place 0.
    power, back = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
    grams = mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    inside = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    anchor = inside.argmin(1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.concatenate([first[1:], [len(anchor)]]) - 1 + window
    digest = mixed((sums[end] - sums[first]) * back[first])
    return grams[anchor[first]].view(np.int64), digest.view(np.int64), first, end - first


class Automaton:
    """A suffix automaton of several word sequences, added one after the other."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            made = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = made
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = made

    def matches(self, sequence: list[int]) -> list[int]:
        """For each place the length of the longest match that ends there."""
        follow, link, length = self.next, self.link, self.length
        state = size = 0
        found = []
        for c in sequence:
            while state and c not in follow[state]:
                state = link[state]
                size = length[state]
            to = follow[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            found.append(size)
        return found


def spans_of(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """The union of the windows that end where a match is long enough."""
    spans: list[tuple[int, int]] = []
    for i, size in enumerate(lengths):
        if size >= window:
            start = i + 1 - window
            if spans and spans[-1][1] >= start:
                spans[-1] = spans[-1][0], i + 1
            else:
                spans.append((start, i + 1))
    return spans


def _passage_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in slices(batches, _ROWS):
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for key, digest, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_hash", "text"))):
            found = passages(known.of(known.words(text)), window, gram)
            n = len(found[0])
            for column, values in zip(columns, (*found, np.full(n, key), np.full(n, digest))):
                column.append(values)
        arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["anchor", "digest", "start", "size", "_id", "_hash"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of asked-for passages."""
    known = WordHashes()
    kind = pa.list_(pa.uint64())
    names = ["anchor", "shard", "_id", "_hash", "start", "added", "words"]
    for batch in slices(batches, 64):
        rows = []
        for key, digest, text, asked in zip(*(batch.column(c).to_pylist() for c in ("_id", "_hash", "text", "asked"))):
            hashes = known.of(known.words(text))
            for a in asked:
                part = hashes[a["start"] : a["start"] + a["size"]].tobytes()
                for shard in range(a["shards"]):
                    rows.append((a["anchor"], shard, key, digest, a["start"], a["digest"] % a["shards"] == shard, part))
        for at in range(0, len(rows), 2000):
            made = list(zip(*rows[at : at + 2000]))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names)


def _matched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Streams sorted passages through the automaton of their shard, which holds smaller ids only."""
    shard = None
    automaton = Automaton()
    waiting: list[list[int]] = []
    waiting_id = None
    names = ["_id", "_hash", "start", "end"]
    for batch in slices(batches, 1000):
        rows = []
        columns = ("anchor", "shard", "_id", "_hash", "start", "added", "words")
        for anchor, part, key, digest, start, added, words in zip(*(batch.column(c).to_pylist() for c in columns)):
            if (anchor, part) != shard:
                shard, automaton, waiting, waiting_id = (anchor, part), Automaton(), [], key
            if key != waiting_id:
                for earlier in waiting:
                    automaton.add(earlier)
                waiting, waiting_id = [], key
            sequence = np.frombuffer(words, dtype=np.uint64).tolist()
            if len(automaton.next) > 1:
                rows += [(key, digest, start + s, start + e) for s, e in spans_of(automaton.matches(sequence), window)]
            if added:
                waiting.append(sequence)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def kept_words(words: list[str], spans: list[tuple[int, int]]) -> list[str]:
    if not spans:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, end in spans:
        change[start] += 1
        change[end] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return [w for w, g in zip(words, gone) if not g]


def _cut(batches: Iterator[pa.RecordBatch], keep: list[str], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    find = re.compile(WORD).findall
    for batch in slices(batches, _ROWS):
        totals, removed, texts = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
            words = find(text)
            left = kept_words(words, [(s["start"], s["end"]) for s in spans or []])
            totals.append(len(words))
            removed.append(len(words) - len(left))
            texts.append(" ".join(left))
        made = [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    gram: int = GRAM,
    names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text"),
) -> DataFrame:
    """The key of every document with its words counted, those removed, and the kept ones joined.

    Windows are judged on the input. A null text has no words; texts shorter than the window keep
    all. Null keys count as larger than all others and not as smaller than each other. Repeated
    rows each give a row; rows that share a key do not remove words from each other. An empty
    table gives no rows. Equality of words is equality of 64-bit hashes, with a run of ``window``
    of them to agree.
    """
    keyed = docs.select(
        F.col(key),
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).select("*", F.xxhash64("text").alias("_hash"))
    schema = "anchor long, digest long, start long, size long, _id long, _hash long"
    rows = keyed.select("_id", "_hash", "text").mapInArrow(lambda b: _passage_rows(b, window, gram), schema)
    rows = rows.select("anchor", "digest", "_id", "_hash", F.expr("start << 24 | size").alias("place"))
    rows = materialise(rows, "passages")
    place = [F.expr("place >> 24").alias("start"), F.expr("place & 16777215").alias("size")]
    # Equal passages: their smallest id. Then for each anchor how many unequal passages it has.
    equal = rows.groupBy("anchor", "digest").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
    around = equal.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("a"), F.max("last").alias("b"))
    around = around.where("kinds > 1 AND a < b").select("anchor", "kinds")
    met = equal.join(around, "anchor", "left").where("first < last OR kinds IS NOT NULL")
    met = met.select("anchor", "digest", "first", F.coalesce("kinds", F.lit(1)).alias("kinds"))
    met = materialise(met, "met-passages")
    found = rows.join(met, ["anchor", "digest"])
    repeats = found.where("_id > first").select("_id", "_hash", *place)
    repeats = repeats.select("_id", "_hash", "start", (F.col("start") + F.col("size")).alias("end"))
    shards = F.ceil(F.col("kinds") / SHARD_PASSAGES).cast("long").alias("shards")
    asked = (
        found.where("_id = first AND kinds > 1")
        .select("_id", "_hash", F.struct("anchor", "digest", *place, shards).alias("ask"))
        .groupBy("_id", "_hash")
        .agg(F.collect_list("ask").alias("asked"))
    )
    # The same columns of the documents as in the last join, so that one exchange of texts serves both.
    sequences = keyed.join(asked, ["_id", "_hash"]).select("_id", "_hash", key, "text", "asked")
    sequences = sequences.mapInArrow(
        _sequences, "anchor long, shard long, _id long, _hash long, start long, added boolean, words binary"
    )
    matched = (
        sequences.repartition("anchor", "shard")
        .sortWithinPartitions("anchor", "shard", "_id")
        .mapInArrow(lambda b: _matched(b, window), "_id long, _hash long, start long, end long")
    )
    spans = (
        repeats.union(matched)
        .groupBy("_id", "_hash")
        .agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    )
    joined = keyed.join(spans, ["_id", "_hash"], "left").select("_id", "_hash", key, "text", "_spans")
    kind = docs.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, {names[0]} long, {names[1]} long, {names[2]} string"
    return joined.mapInArrow(lambda b: _cut(b, [key], names), out)

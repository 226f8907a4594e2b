"""Quality rules as a ledger: each rule is evaluated once, and its outcome kept as one bit.

``measure`` takes the measurements of each text, ``ledger`` turns them into a bit mask of failed
rules. Policies are named sets of rules, so that applying one, comparing versions, or asking what
a rule alone costs (an ablation) are bit operations on the stored mask; no text is read again.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wareseek.llm.common import WORD, slices

SYMBOLS = "#*$%&|<>"
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")
_ROWS = 256


@dataclass(frozen=True)
class Rule:
    """A named condition under which a text fails, over the measurements."""

    name: str
    fails: str


#: Each rule's bit is its place here; new rules are added at the end so that stored masks stay valid.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 4 AND 2 * n_dup_lines > n_lines"),
    Rule("exclamations", "5 * n_exclaims > n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "exclamations", "long_words"),
}
BASE = POLICIES["v1"]


def _repeat_words(words: list[str]) -> int:
    """How many words lie in a three-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    base = len(seen)
    pairs = ids[:-1] * base + ids[1:]
    if base > 2_000_000:  # three ids would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(n - 2, dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= repeated
    return int(covered.sum())


def measurements(text: str, find_words) -> tuple[int, ...]:
    words = find_words(text)
    seen: set[str] = set()
    lines = repeats = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            if line in seen:
                repeats += 1
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        repeats,
        _repeat_words(words),
        lines,
        text.count("!"),
    )


def _measure(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    find_words = re.compile(WORD).findall
    for batch in slices(batches, _ROWS):
        rows = [measurements(t or "", find_words) for t in batch.column(text).to_pylist()]
        made = [pa.array(column, pa.int64()) for column in zip(*rows)]
        keep = [n for n in batch.schema.names if n != text]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *made], [*keep, *MEASUREMENTS])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but for the text, with one long column for each measurement.

    A null or empty text measures 0 throughout. Rows are measured one by one, so repeated rows
    and empty tables need no care; columns of ``docs`` named as a measurement are replaced.
    """
    docs = docs.drop(*[n for n in MEASUREMENTS if n in docs.columns and n != text])
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in MEASUREMENTS]])
    return docs.mapInArrow(functools.partial(_measure, text=text), schema)


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``failed``: bit i is set where rule i fails. Without a measurement a rule passes."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    return measured.withColumn("failed", functools.reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask(names, rules: tuple[Rule, ...] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


def passes(names, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a policy, given by the names of its rules, keeps a row of the ledger."""
    return F.col(failed).bitwiseAND(F.lit(mask(names, rules)).cast("long")) == 0


def ablations(ledgered: DataFrame, names, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only this rule rejects.

    Rows are first counted by mask, at most one count for each combination of rules and task.
    """
    counts = ledgered.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    chosen = [(n, mask([n], rules)) for n in names]
    within = F.col("failed").bitwiseAND(F.lit(mask(names, rules)).cast("long"))
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in chosen]))
    return (
        counts.select("n", within.alias("within"), one.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.expr("within & r.bit != 0"), F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.expr("within = r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )

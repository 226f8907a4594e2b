"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters between words, and a word, as every operator here takes them.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of the table has them already, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def words(text: Column) -> Column:
    """The words of a text, as an array; none for a null text."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda word: word != "")


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a worker holds stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scrambled one to one, so that near numbers become unlike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def splitter(kept: bytes = b"") -> bytes:
    """A table for ``bytes.translate``: A to Z become small, and all ASCII but letters and ``kept`` a space.

    Splitting what it gives yields the runs of letters, of ``kept`` and of characters beyond ASCII.
    """
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for byte in b"abcdefghijklmnopqrstuvwxyz" + kept:
        table[byte] = byte
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    return bytes(table)

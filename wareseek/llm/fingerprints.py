"""Fingerprints of texts as threshold-scaled sketches, by built-in functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Sketches of any two
documents are then samples by the same rule, whatever their sizes: shared hashes over kept ones
estimate how much of one text the other contains, and the sketch of a union is the union of
sketches. The least hash is kept in any case, so only a text without words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wareseek.llm.common import words
from wareseek.llm.secret_scan import let

SHINGLE = 5
FRACTION = 1 / 4
_ROWS_IN_RANGE = 2000
_QUANTILES = 128
_MAX_RANGES = 1 << 16


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The 64-bit hashes of all runs of ``size`` words, or one of the whole text when it is shorter."""

    def of_words(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        runs = F.transform(
            F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + j] for j in range(size)])
        )
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= size, runs).when(F.size(h) > 0, whole).otherwise(none)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)


def sketch(text: Column, fraction: float = FRACTION, size: int = SHINGLE) -> Column:
    """The sorted hashes of a text's sketch; none for a null text or one without words."""
    limit = -(1 << 63) + int(fraction * (1 << 64))

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < limit) if limit < 1 << 63 else hashes
        least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
        return let(low, lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(least))

    return let(shingle_hashes(F.coalesce(text, F.lit("")), size), kept)


def merged(first: Column, second: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    limit = -(1 << 63) + int(fraction * (1 << 64))
    both = F.array_sort(F.array_union(first, second))
    low = F.filter(both, lambda h: h < limit) if limit < 1 << 63 else both
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(first: Column, second: Column) -> Column:
    """Estimated Jaccard similarity. Two empty sketches are alike, an empty and another are not."""

    def of(shared: Column) -> Column:
        union = F.size(first) + F.size(second) - shared
        return F.when(union > 0, shared / union).otherwise(F.lit(1.0))

    return let(F.size(F.array_intersect(first, second)), of)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the shingles of ``part`` that ``whole`` holds; 1 for an empty ``part``."""
    shared = F.size(F.array_intersect(part, whole))
    return F.when(F.size(part) > 0, shared / F.size(part)).otherwise(F.lit(1.0))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _range_of(docs: DataFrame, key: str) -> Column:
    """A number for contiguous ranges of the key with about as many rows each, null keys apart.

    Quantiles give up to ``_QUANTILES`` ranges, whatever the keys are like; each of them is cut
    into equal widths until a range has about ``_ROWS_IN_RANGE`` rows, or more where there would be
    over ``_MAX_RANGES`` ranges.
    """
    shares = [i / _QUANTILES for i in range(_QUANTILES + 1)]
    found = docs.agg(F.count(key).alias("n"), F.percentile_approx(key, shares, 10_000).alias("cuts")).first()
    cuts = sorted(set(found["cuts"] or []))
    if len(cuts) < 2:
        return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    parts = max(1, min(_MAX_RANGES // _QUANTILES, round(found["n"] / _QUANTILES / _ROWS_IN_RANGE)))

    def place(low: int, high: int) -> Column:
        if high - low == 1:
            width = max(1, -(-(cuts[high] - cuts[low]) // parts))
            inside = F.floor((F.col(key) - F.lit(cuts[low])) / width)
            return F.lit(low * parts) + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside))
        middle = (low + high) // 2
        return F.when(F.col(key) < cuts[middle], place(low, middle)).otherwise(place(middle, high))

    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place(0, len(cuts) - 1)).cast("long")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", tie: str = "text") -> DataFrame:
    """Each row with ``columns`` of the next one as ``next_…``, keys descending, the first after the last.

    Rows meet their successors inside ranges of the key, one shuffle and sort of each row; the
    last row of a range gets the first row of the next range that has rows. Ties are ordered by
    ``tie``, null keys come last. A single row is its own successor.
    """
    ranged = docs.withColumn("_range", _range_of(docs, key))
    within = Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), F.col(tie).asc_nulls_first())
    placed = ranged.select("*", F.lead(F.struct(*columns)).over(within).alias("_next"))
    # The first rows of the ranges, of which there are no more than _MAX_RANGES (and one for null
    # keys): few enough to look them up from a broadcast, so that no other row moves again.
    heads = ranged.groupBy("_range").agg(F.max(key).alias("_top"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select(
        "_range", F.coalesce(F.lead("_range").over(down), F.first("_range").over(every)).alias("_after")
    )
    tops = F.broadcast(heads.select(F.col("_range").alias("_after"), "_top"))
    at_top = (F.col("_range") == F.col("_after")) & F.col(key).eqNullSafe(F.col("_top"))
    ordered = F.struct(F.col(tie), F.struct(*columns).alias("_row"))
    firsts = ranged.join(tops, at_top).groupBy("_after").agg(F.min(ordered)["_row"].alias("_first"))
    ends = follows.join(firsts, "_after").select("_range", "_first")
    return placed.join(ends, "_range").select(
        *docs.columns,
        *[F.coalesce(F.col("_next"), F.col("_first"))[c].alias(f"next_{c}") for c in columns],
    )


def fingerprint(docs: DataFrame, text: str = "text", name: str = "sketch", fraction: float = FRACTION) -> DataFrame:
    """Adds the sketch of every text. Rows are taken one by one and other columns pass unchanged.

    A null or empty text has an empty sketch; the added name can be chosen where it would clash.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} exists already; choose another name")
    return docs.withColumn(name, sketch(F.col(text), fraction))

"""Mixing sources to target weights, by built-in functions only.

Source shares of the tokens are raised to an exponent between 0 (all sources alike) and 1 (as
they are) and normalised. The exponent is found by bisection, so that the mixture has a target
entropy or repeats no source more often than allowed. Weights are then realised within a token
budget: every source runs through seeded permutations of its documents, a new one each epoch, and
stops where its part of the budget is used up. The place within that part says to which block a
document belongs, so each block has the weights of the whole, and inside a block the order is a
permutation of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wareseek.llm.common import unused
from wareseek.storage import is_small, materialise

_ROWS_IN_BUCKET = 512
_LEVELS = 4
_MAX_BROADCAST_SOURCES = 100_000
_MAX_BROADCAST_DRAWS = 1_000_000
_EPOCHS_IN_RUN = 4096
_BUCKETS_IN_STRIP = 4096


@dataclass(frozen=True)
class Mixture:
    """What is asked for: ``entropy`` as a share of the most that the sources allow, and
    ``max_repeats``, how often the most repeated source may be run through. Where both are given
    and a tiny source cannot have both, the repeats stay within their limit and the entropy is
    as near its target as that allows. Without ``max_repeats`` nothing bounds the rows a tiny
    source is drawn for. Without a ``budget`` in tokens it is the least with which every document
    occurs; a budget above ``max_repeats`` times all tokens repeats more at any exponent."""

    entropy: float | None = None
    max_repeats: float | None = None
    budget: float | None = None
    block_tokens: int = 1 << 14
    seed: int = 17


def source_totals(units: DataFrame) -> DataFrame:
    return units.groupBy("source").agg(
        F.sum("tokens").cast("double").alias("total"), F.count(F.lit(1)).alias("docs")
    )


def exponent(totals: DataFrame, m: Mixture) -> float:
    """Bisection between 0 and 1; each pass over the totals decides several levels at once."""
    weighed = totals.where("total > 0")
    known = weighed.agg(F.sum("total"), F.min("total"), F.max("total"), F.count(F.lit(1))).first()
    whole, least, most, n = known
    if not n or n == 1 or m.entropy is None and m.max_repeats is None:
        return 1.0
    share = F.col("total") / whole

    def bisected(flat: Callable[[float, float, float], bool]) -> tuple[float, float]:
        """The two ends of a short range below which ``flat`` holds and above which it does not."""
        low, high = 0.0, 1.0
        while high - low > 1e-9:
            tried = [low + (high - low) * i / (1 << _LEVELS) for i in range(1, 1 << _LEVELS)]
            sums = [F.sum(F.pow(share, F.lit(a))) for a in tried]
            sums += [F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in tried]
            row = weighed.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
            for i, a in enumerate(tried):
                if not flat(a, row[i], row[i + len(tried)]):
                    high = a
                    break
                low = a
        return low, high

    def spread(a: float, z: float, logs: float) -> bool:
        return math.log(z) - a * logs / z >= m.entropy * math.log(n)

    def repeating(a: float, z: float, _: float) -> bool:
        budget = m.budget if m.budget is not None else whole * z * (most / whole) ** (1 - a)
        return budget * (least / whole) ** (a - 1) / (z * whole) > m.max_repeats

    # The entropy is reached at the lower end; the repeats stay within their limit at the upper.
    # Both fall as the exponent rises, so the larger exponent keeps the limit on repeats.
    found = [bisected(spread)[0]] if m.entropy is not None else []
    found += [bisected(repeating)[1]] if m.max_repeats is not None else []
    return max(found)


def weights(totals: DataFrame, m: Mixture) -> tuple[DataFrame, float, float]:
    """Each source with its weight and its part of the budget; the exponent; the budget."""
    a = exponent(totals, m)
    row = totals.where("total > 0").agg(F.sum("total"), F.max("total")).first()
    whole, most = row[0] or 1.0, row[1] or 1.0
    power = F.when(F.col("total") > 0, F.pow(F.col("total") / whole, F.lit(a))).otherwise(F.lit(0.0))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    budget = m.budget if m.budget is not None else whole * z * (most / whole) ** (1 - a)
    weight = power / F.lit(z)
    return totals.select("*", weight.alias("weight"), (weight * F.lit(budget)).alias("quota")), a, budget


def _offsets(sums: DataFrame) -> DataFrame:
    """Cells with the tokens of all cells before them, in their strip and then in strips before it,
    so that no task holds all cells of a source."""
    strips = sums.groupBy("source", "epoch", "strip").agg(F.sum("cell_tokens").alias("strip_tokens"))
    earlier = Window.partitionBy("source", "epoch").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select("source", "epoch", "strip", F.coalesce(F.sum("strip_tokens").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "epoch", "strip").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = sums.withColumn("within", F.coalesce(F.sum("cell_tokens").over(inside), F.lit(0)))
    same = (
        F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.epoch") == F.col("s.epoch")) & (F.col("c.strip") == F.col("s.strip"))
    )
    return cells.alias("c").join(strips.alias("s"), same).select(
        "c.source", "c.epoch", "bucket", (F.col("within") + F.col("before")).alias("offset")
    )


def schedule(docs: DataFrame, tokens: Column, m: Mixture, key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each time a document is drawn: key, source, tokens, ``epoch``, ``block``, ``slot``.

    Rows that share key and source are drawn together, with the sum of their tokens. A null
    source is a source of its own, a null key a document of its own in each source. Documents
    without tokens cost nothing and are drawn once an epoch like the others; a source without any
    token is run through once. An empty table gives no rows. A hot source is cut into buckets
    of a few hundred documents by the hash that orders them, so no task sorts a whole source.
    """
    units = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), tokens.alias("tokens"))
    units = materialise(units.groupBy("key", "source").agg(F.sum("tokens").alias("tokens")), "mix-units")
    totals = materialise(source_totals(units), "mix-totals")
    parts, _, budget = weights(totals, m)
    # Documents without tokens need blocks too.
    docs_in_all = totals.agg(F.sum("docs")).first()[0] or 0
    blocks = max(1, math.ceil(budget / m.block_tokens), math.ceil(docs_in_all / m.block_tokens))
    # Times a source is run through whole, and what is left for the last, partial run.
    runs = F.when(F.col("total") > 0, F.col("quota") / F.col("total")).otherwise(F.lit(1.0))
    full = F.floor(runs + 1e-9)
    rest = F.when(runs - full > 1e-9, F.col("quota") - full * F.col("total")).otherwise(F.lit(0.0))
    plan = parts.select(
        "source",
        "total",
        "quota",
        full.alias("full"),
        rest.alias("rest"),
        F.ceil(F.col("docs") / _ROWS_IN_BUCKET).alias("buckets"),
    )
    plan = F.broadcast(plan) if is_small(plan, _MAX_BROADCAST_SOURCES) else plan
    same_source = units["source"].eqNullSafe(plan["source"])
    # Epochs are made in runs, as there can be more of them than one array holds.
    last = F.greatest(F.lit(0).cast("long"), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1))
    runs_of_epochs = F.sequence(F.lit(0).cast("long"), last, F.lit(_EPOCHS_IN_RUN).cast("long"))
    epochs = F.sequence(F.col("first"), F.least(F.col("first") + (_EPOCHS_IN_RUN - 1), F.col("last")))
    drawn = (
        units.join(plan, same_source)
        .where((F.col("full") > 0) | (F.col("rest") > 0))
        .select("key", units["source"], "tokens", "total", "quota", "full", "rest", "buckets", last.alias("last"), F.explode(runs_of_epochs).alias("first"))
        .withColumn("epoch", F.explode(epochs))
        .withColumn("order", F.xxhash64(F.lit(m.seed), "epoch", "source", "key"))
        .withColumn("bucket", F.floor((F.col("order") / 2.0**64 + 0.5) * F.col("buckets")))
    )
    cell = ["source", "epoch", "bucket"]
    strip = F.floor(F.col("bucket") / _BUCKETS_IN_STRIP).alias("strip")
    sums = drawn.groupBy(*cell).agg(F.sum("tokens").alias("cell_tokens")).select("*", strip)
    offsets = _offsets(materialise(sums, "mix-cells")).select(*cell, "offset")
    earlier = Window.partitionBy(*cell).orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    inside = drawn.withColumn("earlier", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    joined = inside.alias("d").join(
        offsets.alias("o"),
        F.col("d.source").eqNullSafe(F.col("o.source"))
        & (F.col("d.epoch") == F.col("o.epoch"))
        & (F.col("d.bucket") == F.col("o.bucket")),
    )
    start = F.col("offset") + F.col("earlier")
    kept = joined.where((F.col("d.epoch") < F.col("full")) | (start < F.col("rest")))
    place = (F.col("d.epoch") * F.col("total") + start) / F.greatest(F.col("quota"), F.lit(1e-300))
    block = F.when(F.col("total") > 0, F.floor(place * blocks)).otherwise(F.pmod(F.col("order"), F.lit(blocks)))
    shuffled = F.xxhash64(F.lit(m.seed + 1), F.col("order"))
    out = kept.select(
        F.col("key").alias(key),
        F.col("d.source").alias(source),
        "tokens",
        F.col("d.epoch").alias("epoch"),
        F.least(F.lit(blocks - 1), block).cast("long").alias("block"),
        shuffled.alias("shuffled"),
    )
    in_block = Window.partitionBy("block").orderBy("shuffled", key, source, "epoch")
    return out.withColumn("slot", F.row_number().over(in_block).cast("long")).drop("shuffled")


def realise(docs: DataFrame, tokens: Column, m: Mixture, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents as the schedule draws them: repeated, blocks together, in their order."""
    drawn = schedule(docs, tokens, m, key, source)
    drawn_key, drawn_source, times_of, at = unused(docs, "drawn_key", "drawn_source", "times", "at")
    times = drawn.groupBy(F.col(key).alias(drawn_key), F.col(source).alias(drawn_source)).agg(
        F.collect_list(F.struct("block", "slot")).alias(times_of)
    )
    # Where the schedule is measured to be small, documents move once, to their blocks.
    times = materialise(times, "mix-times")
    times = F.broadcast(times) if is_small(times, _MAX_BROADCAST_DRAWS) else times
    matched = docs.join(
        times, docs[key].eqNullSafe(times[drawn_key]) & docs[source].eqNullSafe(times[drawn_source])
    )
    return (
        matched.select(*docs.columns, F.explode(times_of).alias(at))
        .repartition(F.col(f"{at}.block"))
        .sortWithinPartitions(f"{at}.block", f"{at}.slot")
        .select(*docs.columns)
    )

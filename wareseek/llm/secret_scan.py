"""Secrets in texts, found by built-in functions only.

Three patterns give the base spans: assignments to names such as ``password``, access keys, and
runs of hexadecimal digits. A fourth kind needs no name or prefix: over each long run of key
characters a window slides, and its Shannon entropy follows from counts that change by the one
character that enters and the one that leaves. Windows above the limit of their character class
are joined to spans, unless an allow-list pattern knows the run as harmless.

Entropy is compared in whole numbers: a window of W characters with counts c has entropy
``log2(W) - sum(c * log2(c)) / W``, and ``c * log2(c)`` is tabled in millionths.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
MIN_ASSIGNED = 12
# Shorter matches are dropped; as these two patterns take whole runs, the length can stand in them.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(1|256|384|512)-",
    r"0123456789|abcdefghijkl|ABCDEFGHIJKL",
)


@dataclass(frozen=True)
class Limits:
    """Least entropy in bits: of windows of hexadecimal digits, and of windows of mixed characters.

    The former must also hold ``digits`` digits; the latter a digit, a capital and a small letter.
    """

    hex_bits: float = 3.0
    mixed_bits: float = 3.75
    digits: int = 3


def _weight(count: int) -> int:
    return round(count * math.log2(count) * 1e6) if count else 0


def most_weight(bits: float, window: int = WINDOW) -> int:
    """The largest sum of weights at which a window still has an entropy of ``bits``."""
    return math.floor(window * (math.log2(window) - bits) * 1e6)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


_CHUNK = 64
_CHARS = 1024


def _before(values: Column, combine: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each element what ``combine`` makes of those before it, beginning with 0.

    Chunks are combined first, and what lies before each chunk follows from those in the same way, so
    the work stays in proportion to the elements.
    """

    def of(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), combine)

    if levels == 0:
        return F.transform(values, lambda _, i: of(F.slice(values, F.lit(1), i)))
    chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int"))
    chunked = F.when(F.size(values) > 0, F.transform(chunks, lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK))))
    chunked = F.coalesce(chunked, F.array().cast("array<array<int>>"))

    def of_parts(parts: Column) -> Column:
        def of_starts(starts: Column) -> Column:
            return F.flatten(
                F.transform(
                    parts,
                    lambda part, c: F.transform(
                        part, lambda _, i: combine(starts[c], of(F.slice(part, F.lit(1), i)))
                    ),
                )
            )

        return let(_before(F.transform(parts, of), combine, levels - 1), of_starts)

    return let(chunked, of_parts)


def _sums_before(sizes: Column) -> Column:
    return _before(sizes, lambda total, x: total + x)


_SPAN = "array<struct<start:int,kind:int,end:int,body:string>>"


def _located(text: Column, pattern: str, kind: int, body: Column, at_start: str = "") -> Column:
    """All matches with their places: what lies between matches gives each one's offset."""

    def of_lengths(lengths: Column) -> Column:
        return let(
            _sums_before(F.transform(lengths, lambda x: x["gap"] + x["size"])),
            lambda before: F.transform(
                lengths,
                lambda x, i: F.struct(
                    (before[i] + x["gap"]).alias("start"),
                    F.lit(kind).alias("kind"),
                    (before[i] + x["gap"] + x["size"]).alias("end"),
                    x["body"].alias("body"),
                ),
            ),
        )

    pattern = at_start + pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The text after the last match is left out: only as many gaps as matches count.
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    lengths = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("found"), body.alias("body")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"), x["body"].alias("body")
        ),
    )
    return F.when(text.rlike(pattern), let(lengths, of_lengths)).otherwise(F.array().cast(_SPAN))


def _flagged(run: Column, offset: Column, limits: Limits) -> Column:
    """The spans of one run whose windows have high entropy."""
    weights = F.array(*[F.lit(_weight(c)) for c in range(WINDOW + 1)])
    chars = F.split(run, "")

    def slide(chars: Column, letters: Column) -> Column:
        places = F.transform(chars, lambda c: F.array_position(letters, c).cast("int") - 1)

        def of_places(places: Column) -> Column:
            start = F.struct(
                F.transform(letters, lambda _: F.lit(0)).alias("counts"),
                F.lit(0).alias("weight"),
                F.lit(0).alias("not_hex"),
                F.lit(0).alias("digits"),
                F.lit(0).alias("capitals"),
                F.lit(0).alias("small"),
                F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
            )

            def step(state: Column, i: Column) -> Column:
                enters, leaves = places[i], F.when(i >= WINDOW, places[i - WINDOW])
                came, went = chars[i], F.when(i >= WINDOW, chars[i - WINDOW])

                def changed(name: str, pattern: str) -> Column:
                    gone = F.when(went.rlike(pattern), 1).otherwise(0)
                    return state[name] + F.when(came.rlike(pattern), 1).otherwise(0) - gone

                more = state["counts"][enters]
                less = state["counts"][leaves]
                weight = F.when(leaves == enters, state["weight"]).otherwise(
                    state["weight"]
                    + weights[more + 1]
                    - weights[more]
                    - F.when(i >= WINDOW, weights[less] - weights[less - 1]).otherwise(0)
                )
                counts = F.transform(
                    state["counts"],
                    lambda c, j: c
                    + F.when(j == enters, 1).otherwise(0)
                    - F.when((i >= WINDOW) & (j == leaves), 1).otherwise(0),
                )
                now = F.struct(
                    counts.alias("counts"),
                    weight.alias("weight"),
                    changed("not_hex", "[^0-9a-fA-F]").alias("not_hex"),
                    changed("digits", "[0-9]").alias("digits"),
                    changed("capitals", "[A-Z]").alias("capitals"),
                    changed("small", "[a-z]").alias("small"),
                    state["spans"].alias("spans"),
                )
                return let(now, lambda s: s.withField("spans", grown(s, i)))

            def grown(s: Column, i: Column) -> Column:
                high = F.when(
                    s["not_hex"] == 0,
                    (s["weight"] <= most_weight(limits.hex_bits)) & (s["digits"] >= limits.digits),
                ).otherwise(
                    (s["weight"] <= most_weight(limits.mixed_bits))
                    & (s["digits"] > 0)
                    & (s["capitals"] > 0)
                    & (s["small"] > 0)
                )
                first, end = offset + i - (WINDOW - 1), offset + i + 1
                n = F.size(s["spans"])
                touches = (n > 0) & (F.get(s["spans"], n - 1)["end"] >= first)
                longer = F.concat(
                    F.slice(s["spans"], F.lit(1), F.greatest(n - 1, F.lit(0))),
                    F.array(F.struct(F.get(s["spans"], n - 1)["start"].alias("start"), end.alias("end"))),
                )
                new = F.concat(s["spans"], F.array(F.struct(first.alias("start"), end.alias("end"))))
                return (
                    F.when((i < WINDOW - 1) | ~high, s["spans"]).when(touches, longer).otherwise(new)
                )

            return F.aggregate(
                F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda s: s["spans"]
            )

        return let(places, of_places)

    return let(chars, lambda chars: let(F.array_distinct(chars), lambda letters: slide(chars, letters)))


def _entropy_spans(text: Column, limits: Limits, allow: tuple[str, ...]) -> Column:
    # Looking behind keeps a search from beginning inside a run that was found too short.
    at_start = "(?<![A-Za-z0-9+/_=-])"
    found = F.regexp_extract_all(text, F.lit(at_start + RUN), F.lit(0))
    runs = _located(text, RUN, KINDS.index("entropy"), found, at_start)

    def suspect(x: Column) -> Column:
        harmless = F.lit(False)
        for pattern in allow:
            harmless = harmless | x["body"].rlike(pattern)
        return x["body"].rlike("[0-9]") & ~harmless

    spans = F.flatten(F.transform(F.filter(runs, suspect), lambda x: _flagged(x["body"], x["start"], limits)))
    return F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), x["end"].alias("end")
        ),
    )


def scan(
    docs: DataFrame,
    text: str = "text",
    limits: Limits = Limits(),
    allow: tuple[str, ...] = ALLOW,
    base: str = "base_spans",
    added: str = "entropy_spans",
) -> DataFrame:
    """Adds two arrays of (start, kind, end): the base spans, and those found by entropy.

    Places count code points and ends are exclusive; ``kind`` is a place in ``KINDS``. Each array
    is sorted by start, then kind. A null or empty text has no spans. Each row is scanned by
    itself, so repeated rows and empty tables need no care; the other columns pass unchanged, and
    the names of the added ones can be chosen where they would clash.
    """
    if {base, added} & set(docs.columns):
        raise ValueError(f"columns {base} or {added} exist already; choose other names")
    whole = F.coalesce(F.col(text), F.lit(""))
    group = F.regexp_extract_all(whole, F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(_located(whole, ASSIGN, 0, group), lambda x: F.length(x["body"]) >= MIN_ASSIGNED)
    none = F.array().cast("array<string>")
    named = F.concat(assigned, _located(whole, ACCESS, 1, none), _located(whole, HEX, 2, none))
    ordered = F.array_sort(
        F.transform(named, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    )
    return docs.withColumns({base: ordered, added: F.array_sort(_entropy_spans(whole, limits, allow))})


def listed(spans: Column) -> Column:
    """Spans as text, ``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def _cut(text: Column, size: int) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.substring(text, c * size + 1, F.lit(size)))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text in chunks, without a walk from its beginning."""
    first = F.floor(start / _CHARS).cast("int")
    n = F.floor(F.greatest(end - 1, start) / _CHARS).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, n), ""), start - first * _CHARS + 1, end - start)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or group of overlapping spans, replaced by a mark."""

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    ordered = F.array_sort(F.coalesce(spans, none))

    def rebuilt(ordered: Column, chunks: Column) -> Column:
        # A span that begins at or after the end of all before it begins a new group.
        ends = _before(F.transform(ordered, lambda x: x["end"]), lambda most, x: F.greatest(most, x))
        cuts = F.transform(F.arrays_zip(ordered.alias("span"), ends.alias("reached")), lambda x: F.struct(
            x["reached"].alias("from"), x["span"]["start"].alias("to")
        ))
        kept = F.transform(
            F.filter(cuts, lambda x: x["to"] >= x["from"]),
            lambda x: F.concat(_piece(chunks, x["from"], x["to"]), F.lit(mark)),
        )
        end = F.array_max(F.transform(ordered, lambda x: x["end"]))
        return F.concat(F.array_join(kept, ""), _piece(chunks, end, F.greatest(end, F.length(text))))

    # Finding a place costs a walk to it, so places are looked up in two steps.
    chunks = F.flatten(F.transform(_cut(text, _CHARS * _CHUNK), lambda part: _cut(part, _CHARS)))
    made = let(ordered, lambda spans: let(chunks, lambda parts: rebuilt(spans, parts)))
    return F.when(F.size(spans) > 0, made).otherwise(text)

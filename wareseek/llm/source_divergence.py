"""How the sources of a language differ in the words they use.

Identical texts of a language are collapsed before anything is counted: a text keeps how often each
source holds it, is cut into terms once, and adds its document frequencies and counts with those
multiplicities. Copies are first added up inside each task, so that a text that a third of all rows hold
travels once per task.

Pairs of sources are compared over sparse vectors. Most terms of a language occur in neither of two
sources and all add the same value, known from the sizes alone; a term changes that only for the
sources it occurs in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from wareseek.llm.common import slices, splitter
from wareseek.storage import is_small, materialise

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
_TERM_BYTES = splitter()
_ROWS = 512
_REMEMBERED = 200_000
_COUNTED = 500_000
_CELLS = 4_000_000
_MAX_BROADCAST_GROUPS = 200_000


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a language once per task, and how often else each source holds it."""
    names = ["lang", "digest", "source", "text", "copies"]
    seen: set[tuple[str, bytes]] = set()
    again: Counter = Counter()

    def rest() -> pa.RecordBatch:
        columns = list(zip(*((*key, n) for key, n in again.items())))
        kinds = (pa.string(), pa.binary(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(again), pa.binary()), pa.array(columns[3], pa.int64())], names)

    for batch in slices(batches, _ROWS):
        texts = batch.column("text").cast(pa.binary())
        keys = list(zip(batch.column("lang").to_pylist(), (xxhash.xxh3_128_digest(t) for t in texts.to_pylist())))
        first = []
        for i, (key, source) in enumerate(zip(keys, batch.column("source").to_pylist())):
            if key in seen:
                again[(*key, source)] += 1
            else:
                seen.add(key)
                first.append(i)
        if first:
            take = pa.array(first)
            digests = pa.array([keys[i][1] for i in first], pa.binary())
            one = pa.array(np.ones(len(first), dtype=np.int64))
            arrays = [batch.column("lang").take(take), digests, batch.column("source").take(take), texts.take(take), one]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if len(seen) + len(again) > _REMEMBERED:
            if again:
                yield rest()
            seen.clear()
            again.clear()
    if again:
        yield rest()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (lang, source, term, n, documents) of occurrences in a source, and of documents of the language.

    A term's documents come with any one of its sources. Rows come sorted by language and text, those that hold
    the text first.
    """
    counts: dict[tuple[str, str | None], Counter] = {}

    def sums() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            if source is None:
                continue
            n = len(terms)
            rest = counts[lang, None]
            documents = [rest.pop(term, 0) for term in terms]
            arrays = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string())]
            arrays += [pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(documents, pa.int64())], ["lang", "source", "term", "n", "documents"])
        counts.clear()

    def add(lang: str, text: bytes, copies: Counter) -> None:
        words = text.translate(_TERM_BYTES).split()
        documents = counts.setdefault((lang, None), Counter())
        total = sum(copies.values())
        if total == 1:
            documents.update(set(words))
            counts.setdefault((lang, next(iter(copies))), Counter()).update(words)
            return
        found = Counter(words)
        for word in found:
            documents[word] += total
        for source, n in copies.items():
            into = counts.setdefault((lang, source), Counter())
            for word, times in found.items():
                into[word] += times * n

    key, text, copies = None, b"", Counter()
    for batch in slices(batches, _ROWS):
        columns = (batch.column(c).to_pylist() for c in ("lang", "digest", "text", "source", "copies"))
        for lang, digest, body, source, n in zip(*columns):
            if (lang, digest) != key:
                if key is not None:
                    add(key[0], text, copies)
                key, text, copies = (lang, digest), body, Counter()
            copies[source] += n
        if sum(map(len, counts.values())) > _COUNTED:
            yield from sums()
    if key is not None:
        add(key[0], text, copies)
    yield from sums()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, sources) of the terms in at least so many documents of a language.

    ``sources`` holds (source, n) of the sources that use the term. ``docs`` has no nulls.
    """
    texts = docs.mapInArrow(_collapsed, "lang string, digest binary, source string, text binary, copies long")
    texts = texts.repartition("lang", "digest").sortWithinPartitions("lang", "digest", F.col("text").isNull())
    sums = texts.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    sums = sums.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by_term = sums.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    return by_term.where(F.col("documents") >= min_docs).drop("documents")


def share(count: Column, n: Column, v: Column) -> Column:
    """The smoothed share of a term in billionths; its digits never overflow."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return 1 + F.call_function("div", wide, (n + 2 * v).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _changes(batches: Iterator[pa.RecordBatch], groups) -> Iterator[pa.RecordBatch]:
    """What terms add to a pair of sources beyond the value of a term that neither has, summed by task."""
    names = ["lang", "source", "item", "change"]
    place = {lang: {source: i for i, (source, _, _) in enumerate(of)} for lang, of in groups.value.items()}
    absent = {lang: np.array([p for _, _, p in of], dtype=np.int64) for lang, of in groups.value.items()}
    rows: dict[tuple[str, int], np.ndarray] = {}

    def sums() -> Iterator[pa.RecordBatch]:
        for (lang, i), row in rows.items():
            of = groups.value[lang]
            other = np.flatnonzero(row)
            pairs = [sorted((of[i][0], of[j][0])) for j in other.tolist()]
            arrays = [pa.array([lang] * len(pairs), pa.string())] + [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(row[other])], names)
        rows.clear()

    for batch in slices(batches, _ROWS):
        for lang, sources in zip(batch.column("lang").to_pylist(), batch.column("sources").to_pylist()):
            of, without = groups.value[lang], absent[lang]
            at = sorted((place[lang][s["source"]], s["n"]) for s in sources)
            i = np.array([x for x, _ in at])
            # Python's integers, as the product may pass 64 bits.
            p = np.array([1 + SCALE * (n + 2) // of[x][1] for x, n in at], dtype=np.int64)
            every = without.copy()
            every[i] = p
            change = _apart(p[:, None], every[None, :]) - _apart(without[i][:, None], without[None, :])
            later = np.zeros(len(of), dtype=bool)
            later[i] = True
            change[later[None, :] & (i[:, None] >= np.arange(len(of))[None, :])] = 0  # a pair of two is counted once
            for k, x in enumerate(i.tolist()):
                if (lang, x) in rows:
                    rows[lang, x] += change[k]
                else:
                    rows[lang, x] = change[k].copy()
            if sum(map(len, rows.values())) > _CELLS:
                yield from sums()
    yield from sums()


def _changes_by_join(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """The same as ``_changes`` where there are too many sources to send them to all tasks."""
    each = terms.select("lang", "term", F.explode("sources").alias("s")).select("lang", "term", F.col("s.source").alias("source"), F.col("s.n").alias("count"))
    each = each.join(groups, ["lang", "source"]).select("lang", "term", "source", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "absent")
    others = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("item_absent"))
    known = each.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = each.join(others, "lang").where("source <> item").join(known, ["lang", "term", "item"], "left")
    met = met.where("q IS NULL OR source < item")
    change = distance(F.col("p"), F.coalesce("q", "item_absent")) - distance(F.col("absent"), F.col("item_absent"))
    return met.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), change.alias("change"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, max_groups: int = _MAX_BROADCAST_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance to the others and its own words.

    Part ``pair`` has a row for every other source of the language, by falling distance over all kept terms;
    part ``term`` the ``top`` terms that the source uses more than the language does. Null texts, languages and
    sources are read as empty text. A group without terms has pairs and no terms, a language of one source has no
    pairs, and one without kept terms has distances of 0. Rows count as often as they occur. Other columns are
    left out, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = materialise(term_counts(read, min_docs), "kept-terms")
    each = terms.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", F.col("s.source").alias("source"), F.col("s.n").alias("count"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    of_group = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = read.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["n", "v", "lang_n"])
    groups = groups.withColumn("absent", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1)))
    groups = materialise(groups, "groups")
    small = is_small(groups, max_groups)
    if small:
        by_lang: dict[str, list] = {}
        for row in groups.select("lang", "source", "n", "v", "absent").collect():  # measured to be small
            by_lang.setdefault(row["lang"], []).append((row["source"], row["n"] + 2 * row["v"], row["absent"]))
        sent = spark.sparkContext.broadcast(by_lang)
        changes = terms.select("lang", "sources").mapInArrow(lambda b: _changes(b, sent), "lang string, source string, item string, change long")
    else:
        changes = _changes_by_join(terms, groups)
    changes = changes.groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("item_absent"))
    pairs = groups.join(others, "lang").where("source < item").join(changes, ["lang", "source", "item"], "left")
    alike = F.col("v") * distance(F.col("absent"), F.col("item_absent"))
    pairs = pairs.select("lang", "source", "item", (alike + F.coalesce("change", F.lit(0))).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way"), "value")
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    sizes = groups.select("lang", "source", "n", "v", "lang_n")
    own = each.join(F.broadcast(sizes) if small else sizes, ["lang", "source"])
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    own = own.where("p > q").select("lang", "source", "part", "item", distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(ranked)

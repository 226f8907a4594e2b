"""The best documents for each of a set of query texts, by inner products of impacts and term weights.

A document is the vector of its impacts, an item the vector of its terms' weights. Documents are ordered by the
length of their vectors and cut into buckets. The longest vectors are searched first and give each
item a score that its tenth-best document reaches at least. From then on a bucket is left for an item when
even a vector of the bucket's greatest length in the item's own direction would stay below (Cauchy and
Schwarz). Inside a bucket, the item's weightiest terms are scored, and what the others could add is bounded
twice: by the lengths of the two rests, and term by term by the greatest impacts in the bucket. Documents
that may still reach the tenth best are scored again, in 64-bit integers.

Items are a stated set of queries and go against all documents in blocks of bounded size. Texts are
read once for a block: counts of the block's terms are kept, a few bytes for each term of a document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wareseek.llm.common import mixed, slices, splitter
from wareseek.storage import materialise, scratch_path

TOP = 10
#: Pairs of item and term in one block, and documents searched first.
BLOCK_PAIRS = 500_000
HEAD_ROWS = 10_000
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = splitter(b"0123456789")
_BUCKET = 2048
_FOCUS = 0.9
_SLACK = 1 + 1e-9
_LAST = (1 << 63) - 1
_BINS = 64
_N_DOCS, _N_TERMS = -1, -2
_COUNTS = "doc_id long, spread long, n long, ids binary, numbers binary, term int, df long"
_VECTORS = "doc_id long, spread long, norm double, ids binary, numbers binary"
_FOUND = "item int, doc_id long, score long"


def _term_counts(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
    """The counts of known terms of each document, and at the end this task's sums for every term."""
    known = {term: i for i, term in enumerate(terms.value)}
    df = np.zeros(len(known), dtype=np.int64)
    n_docs = n_terms = row = 0
    first = TaskContext.get().partitionId() << 33
    names = ["doc_id", "spread", "n", "ids", "numbers", "term", "df"]
    for batch in slices(batches, _BUCKET):
        kept, sizes, ids, numbers = [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words = text.translate(_TERM_BYTES).split()
            if not words:
                continue
            n_docs, n_terms = n_docs + 1, n_terms + len(words)
            found = [(known[w], c) for w, c in Counter(words).items() if w in known]
            if not found:
                continue
            pairs = np.array(found, dtype=np.int32)
            df[pairs[:, 0]] += 1
            kept.append(i)
            sizes.append(len(words))
            ids.append(pairs[:, 0].tobytes())
            numbers.append(pairs[:, 1].tobytes())
        if kept:
            spread = mixed(np.arange(first + row, first + row + len(kept), dtype=np.uint64)).view(np.int64)
            row += len(kept)
            arrays = [batch.column("doc_id").take(pa.array(kept)), pa.array(spread), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            none = [pa.nulls(len(kept), pa.int32()), pa.nulls(len(kept), pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(numbers, pa.binary()), *none], names)
    seen = np.flatnonzero(df)
    sums = pa.array(np.concatenate([[n_docs, n_terms], df[seen]]).astype(np.int64))
    of = pa.array(np.concatenate([[_N_DOCS, _N_TERMS], seen]).astype(np.int32))
    none = [pa.nulls(len(of), kind) for kind in (pa.int64(),) * 3 + (pa.binary(),) * 2]
    yield pa.RecordBatch.from_arrays([*none, of, sums], names)


def _impacts(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, weights) -> Iterator[pa.RecordBatch]:
    """Vectors of impacts and their lengths, over the terms that weigh anything."""
    useful = weights.value > 0
    for batch in slices(batches, _BUCKET):
        # Python's integers, as the product may pass 64 bits.
        m = [10 + 90 * n * n_docs // n_terms for n in batch.column("n").to_pylist()]
        rows, norms, ids, numbers = [], [], [], []
        for i, (of, tf) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("numbers").to_pylist())):
            of, tf = np.frombuffer(of, np.int32), np.frombuffer(tf, np.int32).astype(np.int64)
            use = useful[of]
            if not use.any():
                continue
            tf = tf[use]
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[i])
            rows.append(i)
            norms.append(math.sqrt(float((impact.astype(np.float64) ** 2).sum())))
            ids.append(of[use].tobytes())
            numbers.append(impact.astype(np.int32).tobytes())
        if rows:
            keys = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "spread")]
            arrays = [*keys, pa.array(norms), pa.array(ids, pa.binary()), pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "spread", "norm", "ids", "numbers"])


class Items:
    """Weight vectors of the items: their terms by falling weight, the weightiest of them the focus."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        self.terms = [np.array(sorted(t, key=lambda i: (-weights[i], i)), dtype=np.int64) for t in terms]
        self.weights = [weights[t] for t in self.terms]
        self.norms = np.array([math.sqrt(float((w.astype(np.float64) ** 2).sum())) for w in self.weights])
        self.focus, self.rest = [], []
        for w in self.weights:
            squares = w.astype(np.float64) ** 2
            held = np.cumsum(squares)
            cut = int(np.searchsorted(held, _FOCUS * held[-1])) + 1 if len(w) else 0
            self.focus.append(cut)
            self.rest.append(math.sqrt(float(squares[cut:].sum())))

    def __len__(self) -> int:
        return len(self.terms)


class Bucket:
    """Vectors of similar length: by document, and as postings by term."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int):
        doc_id = batch.column("doc_id")
        self.doc_id = doc_id.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.norms = batch.column("norm").to_numpy()
        ids = [np.frombuffer(b, np.int32) for b in batch.column("ids").to_pylist()]
        self.ids = np.concatenate(ids)
        self.impacts = np.concatenate([np.frombuffer(b, np.int32) for b in batch.column("numbers").to_pylist()]).astype(np.int64)
        self.sizes = np.array([len(i) for i in ids])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        order = np.argsort(self.ids, kind="stable")
        self.row = np.repeat(np.arange(len(ids)), self.sizes)[order]
        self.impact = self.impacts[order].astype(np.float64)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=n_terms))])
        used = np.flatnonzero(np.diff(self.at))
        self.greatest = np.zeros(n_terms)
        self.greatest[used] = np.maximum.reduceat(self.impact, self.at[used])

    def survivors(self, terms: np.ndarray, weights: np.ndarray, focus: int, rest: float, least: int) -> np.ndarray:
        """Rows whose score may be ``least`` or more."""
        lists = [slice(self.at[t], self.at[t + 1]) for t in terms[:focus].tolist()]
        row = np.concatenate([self.row[x] for x in lists])
        impact = np.concatenate([self.impact[x] for x in lists])
        weight = np.repeat(weights[:focus].astype(np.float64), [x.stop - x.start for x in lists])
        n = len(self.norms)
        reached = np.bincount(row, weight * impact, minlength=n)
        left = np.maximum(self.norms**2 * _SLACK - np.bincount(row, impact * impact, minlength=n), 0)
        by_term = float((weights[focus:] * self.greatest[terms[focus:]]).sum())
        return np.flatnonzero((reached + np.minimum(rest * np.sqrt(left), by_term)) * _SLACK >= least)

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``weights`` has a place for every term."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.ids[at]] * self.impacts[at], ends - sizes)


def _search(batches: Iterator[pa.RecordBatch], items, least, n_terms: int, top: int) -> Iterator[pa.RecordBatch]:
    """This task's best documents for each item among those that reach the item's least score."""
    items = items.value
    least = least.value.copy()
    dense = np.zeros(n_terms, dtype=np.int64)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in slices(batches, _BUCKET):
        bucket = Bucket(batch, n_terms)
        longest = float(bucket.norms.max())
        for q in np.flatnonzero(items.norms * longest * _SLACK >= least).tolist():
            terms, weights = items.terms[q], items.weights[q]
            rows = bucket.survivors(terms, weights, items.focus[q], items.rest[q], int(least[q]))
            if not len(rows):
                continue
            dense[terms] = weights
            scores = bucket.scores(rows, dense)
            dense[terms] = 0
            good = scores >= least[q]
            if not good.any():
                continue
            ids, scores = bucket.doc_id[rows[good]], scores[good]
            if q in best:
                ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
            order = np.lexsort((ids, -scores))[:top]
            best[q] = ids[order], scores[order]
            if len(order) == top:
                least[q] = max(least[q], scores[order[-1]])
    for q, (ids, scores) in best.items():
        item = pa.array(np.full(len(ids), q, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=ids == _LAST), pa.array(scores)], ["item", "doc_id", "score"])


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _cut(vectors: DataFrame, rows: int) -> float:
    """A length that about so many vectors reach, from a histogram of a fixed number of bins."""
    bins = vectors.groupBy(F.floor(F.log2("norm") * _BINS).alias("bin")).count().collect()
    seen = 0
    for bin, count in sorted(map(tuple, bins), reverse=True):
        seen += count
        if seen >= rows:
            return 2 ** (bin / _BINS)
    return 0.0


def _search_block(docs: DataFrame, pairs: list, top: int, head_rows: int) -> DataFrame | None:
    """The ranked documents (item, doc_id, score, rank) of one block of items, numbered as in ``pairs``."""
    context = docs.sparkSession.sparkContext
    vocabulary = sorted({term.encode() for _, term in pairs})
    place = {term: i for i, term in enumerate(vocabulary)}
    terms = context.broadcast(vocabulary)
    counts = materialise(docs.mapInArrow(lambda b: _term_counts(b, terms), _COUNTS), "term-counts")
    sums = dict(map(tuple, counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("df")).collect()))
    n_docs, n_terms = sums.get(_N_DOCS) or 0, sums.get(_N_TERMS) or 0
    if not n_docs:
        return None
    df = [sums.get(i) or 0 for i in range(len(vocabulary))]
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df]
    weights = np.array(weight, dtype=np.int64)
    of_item: list[list[int]] = [[] for _ in range(1 + max(item for item, _ in pairs))]
    for item, term in pairs:
        if weights[place[term.encode()]] > 0:
            of_item[item].append(place[term.encode()])
    shared = context.broadcast(weights)
    vectors = counts.where("term IS NULL").mapInArrow(lambda b: _impacts(b, n_docs, n_terms, shared), _VECTORS)
    # Copies have vectors of one length; the second key deals them over the ranges.
    vectors = vectors.repartitionByRange(F.col("norm").desc(), "spread").sortWithinPartitions(F.col("norm").desc())
    vectors = materialise(vectors, "impact-vectors")
    items = context.broadcast(Items(of_item, weights))
    size = len(vocabulary)

    def searched(part: DataFrame, least: np.ndarray, name: str) -> DataFrame:
        bound = context.broadcast(least)
        return materialise(part.mapInArrow(lambda b: _search(b, items, bound, size, top), _FOUND), name)

    cut = _cut(vectors, head_rows)
    # An item without useful terms has a length of zero and is never active.
    least = np.ones(len(of_item), dtype=np.int64)
    head = _ranked(searched(vectors.where(F.col("norm") >= cut), least, "head"), top)
    for item, score in head.where(F.col("rank") == top).select("item", "score").collect():
        least[item] = score
    rest = searched(vectors.where(F.col("norm") < cut), least, "rest")
    return _ranked(head.drop("rank").union(rest), top)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    key: str = "doc_id",
    item: str = "item_id",
    block_pairs: int = BLOCK_PAIRS,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents with the highest scores above 0 for each item.

    Terms are runs of letters, digits and non-ASCII characters; A to Z are lower-cased. Null texts have no
    terms. Rows that share an item id are read as one item; one without known terms gives no rows. Each row of
    the documents ranks by itself, also when keys repeat; equal scores go by the key, nulls last. Keys are
    integers. Other columns are left out, whatever their names. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = F.explode(F.regexp_extract_all("text", F.lit(f"({_TERM})"), F.lit(1)))
    lower = F.translate(F.col("term"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = items.select(F.col(item).alias("id"), "text").select("id", found.alias("term")).select("id", lower.alias("term"))
    pairs = materialise(pairs.distinct(), "items")
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    folder = scratch_path(spark, "ranked")
    kind = items.schema[item].dataType
    out = f"id {kind.simpleString()}, rank int, doc_id long, score long"
    spark.createDataFrame([], out).write.parquet(folder)
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # a block of bounded size
        ids = list({row["id"] for row in mine})
        number = {value: i for i, value in enumerate(ids)}
        ranked = _search_block(read, [(number[r["id"]], r["term"]) for r in mine], top, head_rows) if mine else None
        if ranked is not None:
            named = spark.createDataFrame([(i, value) for i, value in enumerate(ids)], f"item int, id {kind.simpleString()}")
            result = ranked.join(F.broadcast(named), "item").select("id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            result.write.mode("append").parquet(folder)
    result = spark.read.schema(out).parquet(folder)
    return result.select(F.col("id").alias(item), "rank", F.col("doc_id").cast(docs.schema[key].dataType).alias(key), "score")

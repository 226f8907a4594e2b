"""Approximate vector search: random hyperplanes deal vectors into buckets, buckets meet by equality.

A table of the index gives every vector a bucket, the signs of its products with ``bits`` random hyperplanes.
Vectors at an angle share a bucket with probability ``(1 - angle / pi) ** bits``, so several tables
together find most near ones. Searching is an equi-join of the queries' buckets with the stored ones; the rows
found are scored exactly. Buckets of many rows, such as those of copies, are stored in parts, and a query goes
to all parts of its bucket, so no join key holds more than ``PART_ROWS`` rows of a bucket.

The pairs of that join grow with queries times rows. The sizes of the buckets tell how many there will be; where
they are more than ``PAIRS_PER_ROW`` for each row, they are never listed: slices of queries with their buckets go to
the rows, each task meets and scores a block of rows at a time, and only its best rows of each query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from wareseek.functions.vectors import unit_query, usable_matrix
from wareseek.operators.batch import BlockScorer, best_per_query, query_slices, refuse_repeated
from wareseek.operators.ranking import top_n_per_query
from wareseek.operators.vector import MAX_QUERIES_PER_PASS, nearest_per_query
from wareseek.storage import is_small, materialise, scratch_scope

PART_ROWS = 50_000
MAX_BROADCAST = 1_000_000
#: Cells that are named in the scan filter of the stored index.
MAX_CELLS_IN_FILTER = 1_000
#: Conditions that leave no more rows than this are searched exactly: what is nearest among few rows is far.
EXACT_ROWS = 100_000
#: Rows that the choice of a number of bits and tables looks at.
SAMPLE_ROWS = 4_000
#: Pairs of a query and a row in one of its buckets that are listed and shuffled, for each indexed row.
PAIRS_PER_ROW = 4
_BLOCK = 2_048


@dataclass(frozen=True)
class Planes:
    """Hyperplanes with entries of 1 and -1, drawn from a seed."""

    dims: int
    bits: int
    tables: int
    seed: int = 7

    def matrix(self) -> np.ndarray:
        """One row for each bit of each table."""
        return np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables * self.bits, self.dims))

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Vectors x tables: bucket and table as one number."""
        signs = (units @ self.matrix().T > 0).reshape(len(units), self.tables, self.bits)
        return (signs @ (1 << np.arange(self.bits))) + (np.arange(self.tables) << self.bits)


def choose_planes(sample: np.ndarray, n: int = 20, recall: float = 0.95, max_tables: int = 64, seed: int = 7) -> Planes:
    """Bits and tables with which the ``n`` nearest of sampled vectors are found, at the fewest candidates.

    The neighbours of a sample lie farther away than those in the whole table, so the estimate is on the
    safe side. Where no choice within ``max_tables`` reaches the recall, one bit is used.
    """
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    queries = units[:: max(1, len(units) // 200)]
    meet = 1 - np.arccos(np.clip(queries @ units.T, -1, 1)) / np.pi
    # Without the vector itself, which every table finds.
    near = np.sort(meet, axis=1)[:, -min(n + 1, len(units)) : -1] if len(units) > 1 else meet
    best, least = Planes(units.shape[1], 1, max_tables, seed), np.inf
    for bits in range(1, 21):
        missed, tables = 1 - near**bits, 1
        while tables <= max_tables and 1 - (missed**tables).mean() < recall:
            tables += 1
        if tables > max_tables:
            break
        candidates = 1 - ((1 - meet**bits) ** tables).mean()
        if candidates < least:
            best, least = Planes(units.shape[1], bits, tables, seed), candidates
    return best


def _with_cells(rows: DataFrame, planes: Planes, key: str, vector: str) -> DataFrame:
    """(key, cell) for every table, of the vectors that have a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                block = batch.slice(at, _BLOCK)
                units, usable = usable_matrix(block.column(vector), planes.dims)
                cells = planes.cells(units)
                keys = block.column(key).filter(pa.array(usable))
                ends = np.arange(len(units) + 1, dtype=np.int32) * planes.tables
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([keys, lists], [key, "cells"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key, vector).filter(F.col(vector).isNotNull()).mapInArrow(run, f"{key} {kind}, cells array<long>")
    return found.select(key, F.explode("cells").alias("cell"))


def _pair_score(a: str, b: str, dims: int, digits: int) -> Column:
    """Cosine of two vector columns mapped to 0..1, NULL where one is not usable."""

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.full(len(left), np.nan)
        for at in range(0, len(left), _BLOCK):
            x, has_x = usable_matrix(left.slice(at, _BLOCK), dims)
            y, has_y = usable_matrix(right.slice(at, _BLOCK), dims)
            both = has_x & has_y
            out[at : at + _BLOCK][both] = np.einsum("ij,ij->i", x[both[has_x]], y[both[has_y]])
        return pa.array(out, mask=np.isnan(out))

    return F.round((1 + score(F.col(a), F.col(b))) / 2, digits)


def _meeting(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Which of the rows share a bucket with which of the queries: rows x queries, from the cells of both."""
    meets = np.zeros((len(rows), len(queries)), dtype=bool)
    for table in range(rows.shape[1]):
        order = np.argsort(queries[:, table], kind="stable")
        sorted_cells = queries[order, table]
        first = np.searchsorted(sorted_cells, rows[:, table], side="left")
        found = np.searchsorted(sorted_cells, rows[:, table], side="right") - first
        row = np.repeat(np.arange(len(rows)), found)
        at = np.arange(len(row)) + np.repeat(first - (np.cumsum(found) - found), found)
        meets[row, order[at]] = True
    return meets


def _bucket_similarity(units: np.ndarray, planes: Planes, vector: str, digits: int) -> BlockScorer:
    """Scores of the pairs that share a bucket; all others are no results."""
    asked = planes.cells(units)

    def score(block: pa.Table) -> np.ndarray:
        scores = np.full((block.num_rows, len(units)), -np.inf)
        column = block.column(vector).combine_chunks()
        for at in range(0, block.num_rows, _BLOCK):
            rows, usable = usable_matrix(column.slice(at, _BLOCK), planes.dims)
            cosine = np.round((1 + rows @ units.T) / 2, digits)
            scores[at : at + _BLOCK][usable] = np.where(_meeting(planes.cells(rows), asked), cosine, -np.inf)
        return scores

    return score


@dataclass(frozen=True)
class VectorIndex:
    """The buckets of a stored catalog's vectors."""

    entries: DataFrame
    cells: DataFrame
    planes: Planes
    key: str = "_id"
    vector: str = "description_embedding"

    @classmethod
    def build(
        cls,
        catalog: DataFrame,
        path: str,
        planes: Planes | None = None,
        key: str = "_id",
        vector: str = "description_embedding",
        part_rows: int = PART_ROWS,
        dims: int | None = None,
    ) -> VectorIndex:
        """Index every row that has a usable vector, and write the index to ``path``.

        Without ``planes``, bits and tables are chosen on at most ``SAMPLE_ROWS`` rows, taken by hash of
        the key; ``dims`` is then the size of usable vectors.
        """
        spark = catalog.sparkSession
        if planes is None:
            taken = catalog.filter(F.size(vector) == dims).select(key, vector).orderBy(F.xxhash64(key)).limit(SAMPLE_ROWS)
            sample = np.array([r[vector] for r in taken.collect()], dtype=np.float64).reshape(-1, dims)
            sample = sample[np.isfinite(sample).all(axis=1) & sample.any(axis=1)]
            planes = choose_planes(sample) if len(sample) else Planes(dims, 1, 1)
        with scratch_scope(spark):
            cells = materialise(_with_cells(catalog, planes, key, vector), "vector-cells")
            size = F.count(F.lit(1))
            sizes = cells.groupBy("cell").agg(size.alias("rows"), F.ceil(size / part_rows).cast("int").alias("parts"))
            sizes.write.parquet(f"{path}/cells")
            large = spark.read.parquet(f"{path}/cells").filter("parts > 1").drop("rows")
            sent = F.broadcast(large) if is_small(large, MAX_BROADCAST) else large
            dealt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(key), F.col("parts"))).otherwise(0).cast("int")
            placed = cells.join(sent, "cell", "left").select("cell", dealt.alias("part"), key)
            # Sorted by cell, so that a few queries open only the row groups of their cells.
            placed = placed.repartitionByRange("cell", "part", key).sortWithinPartitions("cell", "part")
            placed.write.parquet(f"{path}/entries")
        spark.createDataFrame([{**asdict(planes), "key": key, "vector": vector}]).write.parquet(f"{path}/planes")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        stored = spark.read.parquet(f"{path}/planes").first().asDict()
        key, vector = stored.pop("key"), stored.pop("vector")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("entries"), read("cells"), Planes(**stored), key, vector)

    @property
    def large(self) -> DataFrame:
        """The cells that are stored in parts, and in how many."""
        return self.cells.filter("parts > 1").drop("rows")

    def few_pairs(self, queries: DataFrame) -> bool:
        """Whether the pairs of a query and a row in one of its buckets are at most ``PAIRS_PER_ROW`` for each row."""
        probes = _with_cells(queries, self.planes, "query_id", "vector").groupBy("cell").count()
        pairs = probes.join(self.cells, "cell").agg(F.sum(F.col("count") * F.col("rows"))).first()[0]
        stored = self.cells.agg(F.sum("rows")).first()[0]
        return (pairs or 0) * self.planes.tables <= PAIRS_PER_ROW * (stored or 0)

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, key) of all rows that share a bucket with a query, each pair once."""
        probes = _with_cells(queries, self.planes, "query_id", "vector")
        large = F.broadcast(self.large) if is_small(self.large, MAX_BROADCAST) else self.large
        last = F.coalesce(F.col("parts") - 1, F.lit(0))
        probes = probes.join(large, "cell", "left").select("query_id", "cell", F.explode(F.sequence(F.lit(0), last)).alias("part"))
        probes = materialise(probes, "probes")
        entries = self.entries
        few = probes.select("cell").distinct().limit(MAX_CELLS_IN_FILTER + 1).collect()
        if len(few) <= MAX_CELLS_IN_FILTER:
            entries = entries.filter(F.col("cell").isin([r["cell"] for r in few]))
        probes = F.broadcast(probes) if is_small(probes, MAX_BROADCAST) else probes
        return entries.join(probes, ["cell", "part"]).select("query_id", self.key).distinct()

    def nearest(
        self,
        catalog: DataFrame,
        queries: DataFrame,
        n: int,
        where: Column | None = None,
        exact: bool | None = None,
        digits: int = 9,
    ) -> DataFrame:
        """The ``n`` nearest rows of each query of a table ``(query_id, vector)``.

        Gives ``(query_id, key, img, name, score, rank)`` like :func:`nearest_per_query`, which ``exact`` runs instead.
        Scores are exact; a near row that shares no bucket with the query is missed. Conditions apply before
        the cut to ``n``. Unless ``exact`` says otherwise, conditions that leave at most ``EXACT_ROWS`` rows are
        searched exactly. Queries without a direction have no results; repeated or missing ids are refused.
        ``catalog`` is the table that the index was built on.
        """
        queries = queries.select("query_id", "vector")
        if exact is None:
            exact = where is not None and catalog.filter(where).limit(EXACT_ROWS + 1).count() <= EXACT_ROWS
        if exact:
            return nearest_per_query(catalog, queries, n, self.vector, where, self.key, digits)
        queries = materialise(queries.filter(F.col("vector").isNotNull()), "queries")
        refuse_repeated(queries)
        rows = catalog if where is None else catalog.filter(where)
        rows = rows.select(self.key, "img", "name", self.vector)
        if not self.few_pairs(queries):
            return self._nearest_of_blocks(rows, queries, n, digits)
        asked = F.broadcast(queries) if is_small(queries, MAX_BROADCAST) else queries
        pairs = self.candidates(queries).join(rows, self.key).join(asked, "query_id")
        scored = pairs.withColumn("score", _pair_score(self.vector, "vector", self.planes.dims, digits))
        scored = scored.select("query_id", self.key, "img", "name", "score").filter(F.col("score").isNotNull())
        return top_n_per_query(scored, n, tie=self.key)

    def _nearest_of_blocks(self, rows: DataFrame, queries: DataFrame, n: int, digits: int) -> DataFrame:
        """The same by a pass over the rows for each slice of queries; no pair is shuffled but the best."""

        def slices() -> Iterator[tuple[list[Row], BlockScorer]]:
            for found in query_slices(queries, MAX_QUERIES_PER_PASS, checked=True):
                directed = [r for r in found if len(r["vector"]) == self.planes.dims]
                directed = [r for r in directed if np.isfinite(r["vector"]).all() and np.any(r["vector"])]
                if directed:
                    units = np.stack([unit_query(r["vector"]) for r in directed])
                    yield directed, _bucket_similarity(units, self.planes, self.vector, digits)

        id_type = queries.schema["query_id"].dataType
        return best_per_query(rows, [self.vector], slices(), id_type, n, self.key, strict=True)

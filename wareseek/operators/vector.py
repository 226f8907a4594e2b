"""Cosine search over stored vectors: one query, or a table of queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from wareseek.functions.vectors import unit_query, unit_vector, usable_matrix, vector_score
from wareseek.operators.batch import BlockScorer, best_per_query, own_conditions, query_slices
from wareseek.operators.filters import FILTER_COLUMNS
from wareseek.operators.ranking import top_n
from wareseek.schemas import SCORE_THRESHOLD

# One slice of a query table is held by every Python worker: at most this many vectors (8 MB at
# 1,024 dimensions).
MAX_QUERIES_PER_PASS = 1_000


def nearest(
    catalog: DataFrame,
    query: Sequence[float],
    n: int,
    vector: str = "description_embedding",
    where: Column | None = None,
    tie: str = "_id",
    digits: int = 9,
) -> DataFrame:
    """The ``n`` rows most similar to ``query`` among those that satisfy ``where``.

    Exact: filter, score in Arrow batches, one heap per task. Rows without a score sort last and
    are dropped after the cut: a filter before it would be pushed below the scoring and run the
    kernel a second time.
    """
    rows = catalog if where is None else catalog.filter(where)
    scored = rows.filter(F.col(vector).isNotNull()).withColumn(
        "score", vector_score(F.col(vector), query, digits)
    )
    return top_n(scored.drop(vector), n, tie=tie).filter(F.col("score").isNotNull())


def vector_search(
    catalog: DataFrame,
    query: Sequence[float],
    n: int,
    vector: str = "description_embedding",
    where: Column | None = None,
    threshold: float = SCORE_THRESHOLD,
    tie: str = "_id",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Filter, take the ``n`` nearest, then drop those below ``threshold`` (so maybe fewer)."""
    columns = [tie, "img", "name", *extra]
    needed = catalog if where is None else catalog.filter(where)
    best = nearest(needed.select(*columns, vector), query, n, vector, tie=tie)
    return best.filter(F.col("score") >= threshold).select(*columns, "score")


def nearest_per_query(
    catalog: DataFrame,
    queries: DataFrame,
    n: int,
    vector: str = "description_embedding",
    where: Column | None = None,
    tie: str = "_id",
    digits: int = 9,
    checked: bool = False,
) -> DataFrame:
    """``nearest`` for a table ``(query_id, vector)``: ``(query_id, tie, img, name, score, rank)``.

    ``where`` applies to all queries. A table with the columns of ``REQUEST_COLUMNS`` states
    conditions per query as well, in the strict form. A slice of queries is one matrix, and scoring
    a block of rows is one matrix product. Query tables beyond one slice take several passes.
    """
    own = own_conditions(queries)
    read = [vector, *(FILTER_COLUMNS if own else ())]
    rows = catalog if where is None else catalog.filter(where)
    rows = rows.select(tie, "img", "name", *read)
    usable = queries.select("query_id", "vector", *own).filter(F.col("vector").isNotNull())

    def slices() -> Iterator[tuple[list[Row], BlockScorer]]:
        for found in query_slices(usable, MAX_QUERIES_PER_PASS, checked):
            directed = [r for r in found if np.isfinite(r["vector"]).all() and np.any(r["vector"])]
            if directed:
                units = np.stack([unit_query(r["vector"]) for r in directed])
                yield directed, _similarity(units, vector, digits)

    id_type = queries.schema["query_id"].dataType
    return best_per_query(rows, read, slices(), id_type, n, tie, strict=True)


def _similarity(queries: np.ndarray, vector: str, digits: int) -> BlockScorer:
    def score(block: pa.Table) -> np.ndarray:
        units, usable = usable_matrix(block[vector], queries.shape[1])
        scores = np.full((len(usable), len(queries)), -np.inf)
        scores[usable] = np.round((1 + units @ queries.T) / 2, digits)
        return scores

    return score


def build_vectors(
    catalog: DataFrame, dims: int, vector: str = "description_embedding", key: str = "_id"
) -> DataFrame:
    """``(key, unit)`` for every vector that has ``dims`` values and a direction."""
    return catalog.select(key, unit_vector(F.col(vector), dims).alias("unit")).filter(
        F.col("unit").isNotNull()
    )

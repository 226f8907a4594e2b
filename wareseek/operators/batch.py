"""Scoring a catalog against a table of queries: slices of queries, blocks of rows, best n each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F, types as T

from wareseek.operators.filters import FACET_LISTS, REQUEST_COLUMNS, Conditions
from wareseek.operators.ranking import top_n_per_query
from wareseek.storage import scratch_path

SCORE_BLOCK_ROWS = 4_096
_ARROW_ID_TYPES = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}

# Scores of one block against the queries of a slice: a rows x queries matrix with -inf where a
# row is not a result.
BlockScorer = Callable[[pa.Table], np.ndarray]


def refuse_repeated(queries: DataFrame) -> None:
    """Raise when a query has no id, or shares it with another."""
    counted = queries.groupBy("query_id").count()
    wrong = counted.filter((F.col("count") > 1) | F.col("query_id").isNull()).limit(5).collect()
    if wrong:
        raise ValueError(f"query ids missing or repeated: {[r['query_id'] for r in wrong]}")


def query_slices(queries: DataFrame, max_rows: int, checked: bool = False) -> Iterator[list[Row]]:
    """Cut a query table into slices of about ``max_rows`` rows, by hash of the id.

    One count decides how many slices there are. More than one are staged in a folder each, so
    that taking a slice reads nothing else, and only one at a time is held here. ``checked`` says that
    the ids are known to be there and unique.
    """
    if not checked:
        refuse_repeated(queries)
    parts = -(-queries.count() // max_rows)
    if parts <= 1:
        rows = queries.collect()
        if rows:
            yield rows
        return
    spark, path = queries.sparkSession, scratch_path(queries.sparkSession, "query-slices")
    sliced = queries.withColumn("_slice", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    sliced.write.partitionBy("_slice").parquet(path)
    stored = spark.read.schema(sliced.schema).parquet(path)
    for part in range(parts):
        rows = stored.filter(F.col("_slice") == part).drop("_slice").collect()
        if rows:
            yield rows


def own_conditions(queries: DataFrame) -> tuple[str, ...]:
    """The request columns, when the table states conditions per query: all of them or none."""
    stated = set(REQUEST_COLUMNS) & set(queries.columns)
    if stated and stated != set(REQUEST_COLUMNS):
        missing = [c for c in REQUEST_COLUMNS if c not in stated]
        raise ValueError(f"conditions per query need all their columns; missing: {missing}")
    return REQUEST_COLUMNS if stated else ()


def best_per_query(
    rows: DataFrame,
    read: Sequence[str],
    slices: Iterable[tuple[list[Row], BlockScorer]],
    id_type: T.DataType,
    n: int,
    tie: str,
    strict: bool,
) -> DataFrame:
    """``(query_id, *columns, score, rank)``: the best ``n`` rows of every query.

    One pass over ``rows`` per slice; a slice is the request rows of its queries and their scorer.
    Columns in ``read`` are only scored. Requests with conditions of their own apply them in the
    strict or the lenient form. Each task keeps its best ``n`` per query, so what is
    shuffled does not grow with the rows that match.

    Several slices run one after the other and their results are staged, so neither the driver
    nor the plan grows with the number of queries.
    """
    unscored = rows.drop(*read)
    schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            *unscored.schema,
            T.StructField("score", T.DoubleType()),
        ]
    )

    def best(of: tuple[list[Row], BlockScorer]) -> DataFrame:
        requests, scorer = of
        task = _task(requests, scorer, list(read), id_type, n, tie, strict)
        return top_n_per_query(rows.mapInArrow(task, schema), n, tie=tie)

    slices = iter(slices)
    first, second = next(slices, None), next(slices, None)
    if first is None:
        none = F.lit(None).cast(id_type).alias("query_id")
        empty = unscored.limit(0).select(none, "*", F.lit(0.0).alias("score"))
        return empty.withColumn("rank", F.lit(0).cast("long"))
    if second is None:
        return best(first)
    path = scratch_path(rows.sparkSession, "batch-results")
    for of in chain([first, second], slices):
        found = best(of)
        found.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path)


def condition_mask(requests: list[Row], strict: bool) -> Callable[[pa.Table], np.ndarray]:
    """Which rows of a block satisfy which request: a rows x requests matrix.

    Strict or lenient as in :class:`Conditions`: an empty facet list admits nothing or everything.
    A missing bound is the default one.
    """
    default = Conditions()
    low, high, floor = (
        np.array([getattr(default, c) if r[c] is None else r[c] for r in requests], dtype=np.float64)
        for c in REQUEST_COLUMNS[:3]
    )
    vocabularies = {}
    for facet, column in FACET_LISTS.items():
        lists = [set(r[column] or ()) for r in requests]
        labels = sorted(set().union(*lists))
        # The last row stands for every other label, and for none.
        is_open = [not wanted and not strict for wanted in lists]
        allowed = [[o or label in w for o, w in zip(is_open, lists)] for label in labels]
        vocabularies[facet] = labels, np.array([*allowed, is_open])

    def mask(block: pa.Table) -> np.ndarray:
        price, rating = (
            block[c].cast(pa.float64()).to_numpy()[:, None] for c in ("price", "rating")
        )
        holds = (price >= low) & (price <= high) & (rating >= floor)
        for facet, (labels, allowed) in vocabularies.items():
            at = pc.index_in(block[facet], value_set=pa.array(labels, pa.string()))
            holds &= allowed[pc.fill_null(at, len(labels)).to_numpy()]
        return holds

    return mask


def _candidates(scores: np.ndarray, ties: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) positions of the best ``n`` rows of each query, ties settled by ``ties``."""
    count = len(scores)
    chosen = scores > -np.inf
    if count > n:
        chosen &= scores >= np.partition(scores, count - n, axis=0)[count - n]
    crowded = np.flatnonzero(chosen.sum(axis=0) > n)
    if len(crowded):
        place = np.empty(count, dtype=np.int64)
        place[pc.array_sort_indices(ties).to_numpy()] = np.arange(count)
        for q in crowded:
            tied = np.flatnonzero(chosen[:, q])
            order = np.lexsort((place[tied], -scores[tied, q]))
            chosen[tied[order[n:]], q] = False
    return np.nonzero(chosen)


def _best_of(table: pa.Table, n: int, tie: str) -> pa.Table:
    keys = [("_query", "ascending"), ("score", "descending"), (tie, "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=keys))
    query = table["_query"].to_numpy()
    starts = np.searchsorted(query, query, side="left")
    return table.filter(pa.array(np.arange(len(query)) - starts < n))


def _task(
    requests: list[Row],
    scorer: BlockScorer,
    read: list[str],
    id_type: T.DataType,
    n: int,
    tie: str,
    strict: bool,
) -> Callable:
    id_values = pa.array([r["query_id"] for r in requests], _ARROW_ID_TYPES[id_type.typeName()])
    mask = condition_mask(requests, strict) if REQUEST_COLUMNS[0] in requests[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, SCORE_BLOCK_ROWS):
                block = pa.Table.from_batches([batch.slice(at, SCORE_BLOCK_ROWS)]).combine_chunks()
                scores = scorer(block)
                if mask is not None:
                    scores[~mask(block)] = -np.inf
                rows, queries = _candidates(scores, block[tie].combine_chunks(), n)
                found = block.drop_columns(read).take(pa.array(rows))
                found = found.append_column("_query", pa.array(queries.astype(np.int64)))
                found = found.append_column("score", pa.array(scores[rows, queries]))
                best = _best_of(found if best is None else pa.concat_tables([best, found]), n, tie)
        if best is not None:
            names = [c for c in best.column_names if c not in ("_query", "score")]
            ids = id_values.take(best["_query"].combine_chunks())
            columns = [ids, *[best[c] for c in names], best["score"]]
            yield from pa.table(columns, names=["query_id", *names, "score"]).to_batches()

    return run

"""Product searches: browse, text, vector, both fused, for one request or a table of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wareseek.functions.text import WHITESPACE, is_blank, primary_image
from wareseek.operators.batch import (
    BlockScorer,
    best_per_query,
    own_conditions,
    query_slices,
    refuse_repeated,
)
from wareseek.operators.filters import FILTER_COLUMNS, Conditions
from wareseek.operators.lexical import LexicalIndex, best_matches, score_names
from wareseek.operators.ranking import (
    fuse,
    rank_score,
    top_n,
    union_ranked,
    with_rank,
)
from wareseek.operators.text_index import TextIndex
from wareseek.operators.vector import MAX_QUERIES_PER_PASS, nearest_per_query, vector_search
from wareseek.schemas import DEFAULT_RESULTS, SCORE_THRESHOLD, TEXT_PENALTY, VECTOR_PENALTY
from wareseek.storage import is_small, materialise

EMBEDDING_COLUMNS = ("name", "description")
SEARCH_TYPES = frozenset({"vector", "lexical"})
# Matches of one text that are broadcast to the catalog; more are joined by a shuffle.
MAX_BROADCAST_HITS = 100_000


@dataclass(frozen=True)
class SearchRequest:
    """One search as a user states it."""

    text: str | None = ""
    conditions: Conditions = field(default_factory=Conditions)
    n: int = DEFAULT_RESULTS
    search_types: Sequence[str] = ("lexical", "vector")
    embedding_column: str = "description"
    threshold: float = SCORE_THRESHOLD
    vector_penalty: float = VECTOR_PENALTY
    text_penalty: float = TEXT_PENALTY

    def __post_init__(self) -> None:
        if self.n < 1:
            raise ValueError("n must be at least 1")
        if self.embedding_column.lower() not in EMBEDDING_COLUMNS:
            raise ValueError(f"embedding_column must be one of {EMBEDDING_COLUMNS}")

    @property
    def blank(self) -> bool:
        return not (self.text or "").strip(WHITESPACE)

    @property
    def vector_column(self) -> str:
        return f"{self.embedding_column.lower()}_embedding"

    @property
    def types(self) -> frozenset[str]:
        return frozenset(t.lower() for t in self.search_types)


def browse(catalog: DataFrame, conditions: Conditions, n: int = DEFAULT_RESULTS) -> DataFrame:
    """Products that satisfy the conditions, best rated first."""
    rows = catalog.filter(conditions.lenient()).select("_id", "img", "name", "price", "rating")
    return top_n(rows, n, score="rating")


def lexical_search(
    catalog: DataFrame,
    text: str,
    conditions: Conditions,
    n: int = DEFAULT_RESULTS,
    index: LexicalIndex | TextIndex | None = None,
) -> DataFrame:
    """Best matching names among the products that satisfy the conditions.

    The conditions filter rows; relevance statistics still cover the whole catalog. With a stored
    index the statistics and matches come from the folders of the text's terms, and only the
    matches are looked up in the catalog; without one, the names are scanned twice. A :class:`TextIndex` reads
    only the blocks of postings that can hold one of the best ``n``.
    """
    if isinstance(index, TextIndex):
        hits = index.best(catalog, text, n, conditions.lenient())
    elif index is None:
        hits = score_names(catalog, text).filter(conditions.lenient())
    else:
        found = index.search(text)
        found = F.broadcast(found) if is_small(found, MAX_BROADCAST_HITS) else found
        hits = catalog.filter(conditions.lenient()).join(found, index.key)
    return top_n(hits.select("_id", "img", "name", "score"), n)


def legacy_search(
    catalog: DataFrame,
    text: str | None,
    conditions: Conditions,
    n: int = DEFAULT_RESULTS,
    index: LexicalIndex | TextIndex | None = None,
) -> DataFrame:
    """Text search when there is text, otherwise browsing; facets play no part."""
    plain = Conditions(conditions.min_price, conditions.max_price, conditions.min_rating)
    request = SearchRequest(text, plain, n)
    if request.blank:
        return format_results(browse(catalog, plain, n), score="rating")
    return format_results(lexical_search(catalog, text, plain, n, index))


def hybrid_search(
    catalog: DataFrame,
    request: SearchRequest,
    embedding: Sequence[float],
    index: LexicalIndex | TextIndex | None = None,
) -> DataFrame:
    """Vector hits and text hits, each turned into reciprocal rank scores and added up by name."""
    near = vector_search(
        catalog,
        embedding,
        request.n,
        request.vector_column,
        request.conditions.strict(),
        request.threshold,
    )
    near = with_rank(near).withColumn("vs_score", rank_score(request.vector_penalty))
    text = lexical_search(catalog, request.text, request.conditions, request.n, index)
    text = with_rank(text).withColumn("fts_score", rank_score(request.text_penalty))
    return fuse(union_ranked(near.drop("score"), text.drop("score")), request.n)


def ai_search(
    catalog: DataFrame,
    request: SearchRequest,
    embed: Callable[[str], Sequence[float]],
    index: LexicalIndex | TextIndex | None = None,
) -> DataFrame:
    """Dispatch on the request and return ``(rank, image, name)``."""
    if request.blank:
        return format_results(browse(catalog, request.conditions, request.n), score="rating")
    if request.types == SEARCH_TYPES:
        hits = hybrid_search(catalog, request, embed(request.text), index)
        return format_results(hits, tie="name")
    if request.types == {"vector"}:
        hits = vector_search(
            catalog,
            embed(request.text),
            request.n,
            request.vector_column,
            request.conditions.strict(),
            request.threshold,
        )
        return format_results(hits)
    if request.types == {"lexical"}:
        hits = lexical_search(catalog, request.text, request.conditions, request.n, index)
        return format_results(hits)
    raise ValueError(f"search types must be taken from {sorted(SEARCH_TYPES)}")


def format_results(hits: DataFrame, score: str = "score", tie: str = "_id") -> DataFrame:
    """``(rank, image, name)`` of a result that is already cut to n rows."""
    ranked = hits if "rank" in hits.columns else with_rank(hits, score, tie)
    return ranked.select("rank", primary_image(F.col("img")).alias("image"), "name")


def batch_lexical_search(
    catalog: DataFrame,
    queries: DataFrame,
    conditions: Conditions | None,
    n: int = DEFAULT_RESULTS,
    index: LexicalIndex | TextIndex | None = None,
    checked: bool = False,
) -> DataFrame:
    """``(query_id, rank, _id, img, name, score)`` for a table ``(query_id, text)``.

    ``conditions`` are shared by all queries; None means that the table states them per query, in
    the columns of ``REQUEST_COLUMNS``. A stored index saves the passes that collect statistics.
    """
    index = index.index() if isinstance(index, TextIndex) else index or LexicalIndex.of(catalog)
    where = None if conditions is None else conditions.lenient()
    return best_matches(catalog, queries, index, n, where, checked=checked)


def batch_hybrid_search(
    catalog: DataFrame,
    queries: DataFrame,
    request: SearchRequest,
    index: LexicalIndex | TextIndex | None = None,
    checked: bool = False,
) -> DataFrame:
    """Hybrid search for a table ``(query_id, text, vector)``; ``request`` holds what they share.

    Queries may state their own conditions (the columns of ``REQUEST_COLUMNS``) and their own
    number of results (``n``).
    """
    # Every step below reads the queries; whatever produced them should run once.
    # A caller that has checked the ids has staged them as well.
    if not checked:
        queries = materialise(queries, "queries")
        refuse_repeated(queries)
    conditions_stated = bool(own_conditions(queries))
    own_n = "n" in queries.columns
    n = (queries.agg(F.max("n")).first()[0] or 1) if own_n else request.n
    shared = None if conditions_stated else request.conditions
    near = nearest_per_query(
        catalog, queries, n, request.vector_column, shared.strict() if shared else None, checked=True
    )
    near = near.filter(F.col("score") >= request.threshold)
    near = near.withColumn("vs_score", rank_score(request.vector_penalty))
    text = batch_lexical_search(catalog, queries, shared, n, index, checked=True)
    text = text.withColumn("fts_score", rank_score(request.text_penalty))
    ranked = union_ranked(near.drop("score"), text.drop("score"))
    if not own_n:
        return fuse(ranked, n, "query_id")
    wanted = queries.select("query_id", "n")
    cut = lambda hits: hits.join(wanted, "query_id").filter(F.col("rank") < F.col("n")).drop("n")
    return cut(fuse(cut(ranked), n, "query_id"))


def batch_browse(
    catalog: DataFrame,
    queries: DataFrame,
    conditions: Conditions | None,
    n: int = DEFAULT_RESULTS,
    checked: bool = False,
) -> DataFrame:
    """Browsing for a table of requests: ``(query_id, rank, _id, img, name, score)``.

    The score is the rating. ``conditions`` are shared, or None where the table states them.
    """
    own = own_conditions(queries)
    read = list(dict.fromkeys(["rating", *(FILTER_COLUMNS if own else ())]))
    rows = catalog if conditions is None else catalog.filter(conditions.lenient())
    rows = rows.filter(F.col("rating").isNotNull()).select("_id", "img", "name", *read)
    slices = (
        (found, _ratings(len(found)))
        for found in query_slices(queries.select("query_id", *own), MAX_QUERIES_PER_PASS, checked)
    )
    id_type = queries.schema["query_id"].dataType
    return best_per_query(rows, read, slices, id_type, n, "_id", strict=False)


def _ratings(queries: int) -> BlockScorer:
    def score(block: pa.Table) -> np.ndarray:
        rating = block["rating"].cast(pa.float64()).to_numpy()
        return np.tile(rating[:, None], (1, queries))

    return score


def batch_ai_search(
    catalog: DataFrame,
    queries: DataFrame,
    request: SearchRequest,
    index: LexicalIndex | TextIndex | None = None,
) -> DataFrame:
    """Dispatch every request of a table ``(query_id, text, vector)``: ``(query_id, rank, image, name)``.

    A blank text is browsed, other requests go by their ``search_types`` where the table has that
    column (an array) and it is not NULL, and by those of ``request`` otherwise. As in the single
    form unknown types are an error. Conditions and numbers of results per request are as in
    :func:`batch_hybrid_search`. Each kind of search is one batch; kinds nobody asked for cost nothing.
    """
    queries = materialise(queries, "requests")
    refuse_repeated(queries)
    shared = F.array(*[F.lit(t) for t in sorted(request.types)])
    stated = F.col("search_types") if "search_types" in queries.columns else F.lit(None)
    types = F.array_sort(F.array_distinct(F.transform(F.coalesce(stated, shared), F.lower)))
    kind = (
        F.when(is_blank(F.col("text")), "browse")
        .when(types == F.array(F.lit("lexical"), F.lit("vector")), "hybrid")
        .when(types == F.array(F.lit("vector")), "vector")
        .when(types == F.array(F.lit("lexical")), "lexical")
    )
    sorted_out = materialise(queries.withColumn("_kind", kind).drop("search_types"), "requests")
    kinds = {r["_kind"] for r in sorted_out.select("_kind").distinct().collect()}
    if None in kinds:
        raise ValueError(f"search types must be taken from {sorted(SEARCH_TYPES)}")
    conditions = None if own_conditions(queries) else request.conditions
    own_n = "n" in queries.columns
    most = (queries.agg(F.max("n")).first()[0] or 1) if own_n else request.n

    def hits(kind: str) -> DataFrame:
        mine = sorted_out.filter(F.col("_kind") == kind).drop("_kind")
        if kind == "hybrid":
            return batch_hybrid_search(catalog, mine, request, index, checked=True)
        if kind == "browse":
            found = batch_browse(catalog, mine, conditions, most, checked=True)
        elif kind == "lexical":
            found = batch_lexical_search(catalog, mine, conditions, most, index, checked=True)
        else:
            where = conditions.strict() if conditions else None
            found = nearest_per_query(catalog, mine, most, request.vector_column, where, checked=True)
            found = found.filter(F.col("score") >= request.threshold)
        if own_n:
            found = found.join(mine.select("query_id", "n"), "query_id").filter(F.col("rank") < F.col("n"))
        return found

    image = primary_image(F.col("img")).alias("image")
    parts = [hits(k).select("query_id", "rank", image, "name") for k in sorted(kinds)]
    if not parts:
        empty = queries.select("query_id", F.lit(0).cast("long").alias("rank"))
        return empty.select("*", F.lit("").alias("image"), F.lit("").alias("name")).limit(0)
    return reduce(DataFrame.unionByName, parts)

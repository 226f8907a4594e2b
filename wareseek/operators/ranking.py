"""Top-n, rank positions, reciprocal rank scores and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# First-round groups per query. Splitting a query's hits keeps any one sort small even when a
# single query matches most of the catalog; the second round sees at most SPLITS * n rows.
SPLITS = 64


def top_n(df: DataFrame, n: int, score: str = "score", tie: str = "_id") -> DataFrame:
    """Best ``n`` rows; one heap per task, no full sort."""
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(n)


def top_n_per_query(
    df: DataFrame,
    n: int,
    query: str = "query_id",
    score: str = "score",
    tie: str = "_id",
    splits: int = SPLITS,
) -> DataFrame:
    """Best ``n`` rows of every query with their zero-based ``rank``.

    ``splits=1`` suits input that already holds only a few rows per query.
    """
    best_first = (F.col(score).desc(), F.col(tie))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))
    if splits > 1:
        df = (
            df.withColumn("_split", F.pmod(F.xxhash64(tie), F.lit(splits)))
            .withColumn("_place", place(query, "_split"))
            .filter(F.col("_place") <= n)
            .drop("_split")
        )
    return (
        df.withColumn("_place", place(query))
        .filter(F.col("_place") <= n)
        .withColumn("rank", (F.col("_place") - 1).cast("long"))
        .drop("_place")
    )


def with_rank(top: DataFrame, score: str = "score", tie: str = "_id") -> DataFrame:
    """Zero-based position in a result that :func:`top_n` has already cut to a few rows."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), F.col(tie))
    return top.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def rank_score(penalty: float, rank: str = "rank") -> Column:
    """Reciprocal rank; a larger penalty flattens the curve and weighs the source down."""
    return F.lit(1.0) / (F.col(rank) + F.lit(penalty) + F.lit(1))


def collect_ranked(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its rows as an array in rank order, for results already cut to n."""
    rows = F.sort_array(F.collect_list(F.struct("rank", *[c for c in df.columns if c not in (*keys, "rank")])))
    return df.groupBy(*keys).agg(rows.alias("docs"))


def union_ranked(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Both result lists as one bag; each side lacks the other's score."""
    return vector_hits.withColumn("source", F.lit(0)).unionByName(
        text_hits.withColumn("source", F.lit(1)), allowMissingColumns=True
    )


def merge_by_name(ranked: DataFrame, *keys: str) -> DataFrame:
    """One row per product name: best score of either source, image of the first hit.

    "First" means vector hits before text hits, then by rank.
    """
    return ranked.groupBy(*keys, "name").agg(
        F.min_by("img", F.struct("source", "rank")).alias("img"),
        F.max("vs_score").alias("vs_score"),
        F.max("fts_score").alias("fts_score"),
    )


def fuse(ranked: DataFrame, n: int, query: str | None = None) -> DataFrame:
    """Add up the scores of both sources and keep the best ``n`` names (per query, if named).

    For a table of queries the hits, at most 2n per query, are brought together once; merging by
    name and ranking then both happen in place.
    """
    if query is not None:
        ranked = ranked.repartition(query)
    merged = (
        merge_by_name(ranked, *([query] if query else []))
        .withColumn("vs_score", F.coalesce("vs_score", F.lit(0.0)))
        .withColumn("fts_score", F.coalesce("fts_score", F.lit(0.0)))
        .withColumn("score", F.round(F.col("fts_score") + F.col("vs_score"), 12))
    )
    if query is not None:
        return top_n_per_query(merged, n, query=query, tie="name", splits=1)
    return with_rank(top_n(merged, n, tie="name"), tie="name")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the stated order.

    An aggregate rather than a window: copies of a hot key collapse inside each task before
    anything is shuffled.
    """
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key in the stated order."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")

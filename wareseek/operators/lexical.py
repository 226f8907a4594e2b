"""Text search on product names: postings, corpus statistics and BM25 relevance."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from wareseek.functions.text import has_token, run_starts, split_tokens, term_frequencies, tokens
from wareseek.operators.batch import best_per_query, BlockScorer, own_conditions, query_slices, refuse_repeated
from wareseek.operators.filters import FILTER_COLUMNS
from wareseek.schemas import BM25_B, BM25_K1
from wareseek.storage import is_small, rows_if_at_most

# A query-term table is broadcast only when it has been counted to be no larger than this
# (a few dozen bytes per row). Beyond it, the join with the postings is a salted shuffle join.
MAX_BROADCAST_TERMS = 200_000
TERM_SALTS = 32
# Up to this many distinct terms are named in the scan filter of a stored index.
MAX_TERMS_IN_FILTER = 1_000
# Queries scored in one pass over the names.
MAX_QUERIES_PER_PASS = 1_000


def build_postings(catalog: DataFrame, text: str = "name", key: str = "_id") -> DataFrame:
    """``(key, term, tf, length)``: one row per distinct term of each document.

    Terms are counted inside the row (sort, then run lengths), so building needs no shuffle.
    """
    return (
        catalog.filter(has_token(F.col(text)))
        .select(key, F.sort_array(tokens(F.col(text))).alias("_sorted"))
        .withColumn("_starts", run_starts(F.col("_sorted")))
        .select(
            key,
            F.size("_sorted").alias("length"),
            F.explode(term_frequencies(F.col("_sorted"), F.col("_starts"))).alias("_posting"),
        )
        .select(key, "_posting.term", "_posting.tf", "length")
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency and total frequency of every term."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")
    )


def corpus_stats(catalog: DataFrame, text: str = "name") -> DataFrame:
    """One row: number of documents that have a token, and their mean length."""
    return (
        catalog.filter(has_token(F.col(text)))
        .select(F.size(tokens(F.col(text))).alias("length"))
        .agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"))
    )


def idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def tf_weight(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length))


def score_names(
    catalog: DataFrame, text: str, field: str = "name", digits: int = 9
) -> DataFrame:
    """Rows that share a term with the query, with their relevance as ``score``.

    Two passes over one column and no shuffle: the first counts documents and matches into a
    single row, the second scores each row on its own.
    """
    terms = Counter(split_tokens(text))
    if not terms:
        return catalog.limit(0).withColumn("score", F.lit(0.0))
    words = list(terms)
    tokenised = catalog.withColumn("_tokens", tokens(F.col(field)))
    corpus = (
        tokenised.filter(has_token(F.col(field)))
        .agg(
            F.struct(
                F.count(F.lit(1)).alias("docs"),
                F.avg(F.size("_tokens")).alias("mean_length"),
                *[
                    F.count_if(F.array_contains("_tokens", word)).alias(f"df{i}")
                    for i, word in enumerate(words)
                ],
            ).alias("corpus")
        )
        .scalar()
    )
    # A plain substring test discards most rows before any is split into tokens.
    may_match = reduce(or_, [F.contains(F.lower(field), F.lit(w)) for w in words])
    matched = (
        catalog.filter(may_match)
        .withColumn("_tokens", tokens(F.col(field)))
        .filter(F.arrays_overlap("_tokens", F.array(*[F.lit(w) for w in words])))
        .withColumn("_corpus", corpus)
    )
    frequencies = {word: F.col(f"_corpus.df{i}") for i, word in enumerate(words)}
    score = relevance("_tokens", terms, F.col("_corpus.docs"), frequencies, F.col("_corpus.mean_length"), digits)
    return matched.withColumn("score", score).drop("_tokens", "_corpus")


def relevance(
    token_list: str, repeats: dict[str, int], docs: Column, frequencies: dict[str, Column], mean_length: Column, digits: int
) -> Column:
    """BM25 of a list of tokens for the words of one query, given the statistics."""
    weights = [
        times * idf(docs, frequencies[word]) * tf_weight(_occurrences(token_list, word), F.size(token_list), mean_length)
        for word, times in repeats.items()
    ]
    return F.round(sum(weights[1:], weights[0]), digits)


def _occurrences(token_list: str, word: str) -> Column:
    return F.size(F.filter(token_list, lambda t: t == word))


def _folder(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    """Postings and statistics of a catalog, lazily derived or read from files."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    key: str = "_id"
    buckets: int | None = None

    @classmethod
    def of(cls, catalog: DataFrame, text: str = "name", key: str = "_id") -> LexicalIndex:
        postings = build_postings(catalog, text, key)
        return cls(postings, term_stats(postings), corpus_stats(catalog, text), key)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "_id") -> LexicalIndex:
        read = lambda table: spark.read.parquet(f"{path}/{table}")
        corpus = read("corpus")
        return cls(read("postings"), read("terms"), corpus, key, corpus.first()["buckets"])

    def save(self, path: str, buckets: int = 64) -> LexicalIndex:
        """Postings in folders by term hash, sorted by term within balanced files.

        A query opens only the folders of its terms, and the postings of a frequent term spread
        over as many files as they need.
        """
        spark = self.postings.sparkSession
        (
            self.postings.withColumn("bucket", _folder(buckets))
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "term")
            .write.partitionBy("bucket")
            .parquet(f"{path}/postings")
        )
        terms = term_stats(spark.read.parquet(f"{path}/postings"))
        terms.withColumn("bucket", _folder(buckets)).hint("rebalance", "bucket").write.partitionBy(
            "bucket"
        ).parquet(f"{path}/terms")
        self.corpus.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/corpus")
        return self.load(spark, path, self.key)

    def search(self, text: str, digits: int = 9) -> DataFrame:
        """``(key, score)`` of every document that matches one query."""
        spark = self.postings.sparkSession
        rows = [("q", term, count) for term, count in Counter(split_tokens(text)).items()]
        wanted = spark.createDataFrame(rows, "query_id string, term string, repeats long")
        return self.score(wanted, digits).drop("query_id")

    def _read_for(self, words: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and term statistics, of stored ones only the folders and terms asked for."""
        if self.buckets is None:
            return self.postings, self.terms
        folders = words.select(_folder(self.buckets).alias("bucket")).distinct().collect()
        wanted = F.col("bucket").isin([r["bucket"] for r in folders])
        few = rows_if_at_most(words, MAX_TERMS_IN_FILTER)
        if few is not None:
            wanted &= F.col("term").isin([r["term"] for r in few])
        return self.postings.filter(wanted), self.terms.filter(wanted)

    def weights(self, query_terms: DataFrame, terms: DataFrame, docs: Column) -> DataFrame:
        """Query terms that occur, with their weight: repeats times inverse document frequency."""
        words = query_terms.select("term").distinct()
        small = is_small(query_terms, MAX_BROADCAST_TERMS)
        # Every term of the index has one row here, so this join has no hot key.
        known = terms.select("term", "df").join(
            F.broadcast(words) if small else words, "term", "left_semi"
        )
        return (
            query_terms.join(F.broadcast(known) if small else known, "term")
            .withColumn("_docs", docs)
            .withColumn("weight", F.col("repeats") * idf(F.col("_docs"), F.col("df")))
            .select("query_id", "term", "weight")
        )

    def score(self, query_terms: DataFrame, digits: int = 9) -> DataFrame:
        """``(query_id, key, score)`` of every match for a table ``(query_id, term, repeats)``.

        All matches are listed, so this suits few or selective queries; :func:`best_matches` finds
        the best n of many.
        """
        postings, terms = self._read_for(query_terms.select("term").distinct())
        weights = self.weights(query_terms, terms, self.corpus.select("docs").scalar())
        if is_small(query_terms, MAX_BROADCAST_TERMS):
            hits = postings.join(F.broadcast(weights), "term")
        else:
            salts = F.explode(F.array(*[F.lit(i) for i in range(TERM_SALTS)]))
            hits = postings.withColumn(
                "_salt", F.pmod(F.xxhash64(self.key), F.lit(TERM_SALTS)).cast("int")
            ).join(weights.withColumn("_salt", salts), ["term", "_salt"])
        part = F.col("weight") * tf_weight(F.col("tf"), F.col("length"), F.col("_mean_length"))
        return (
            hits.withColumn("_mean_length", self.corpus.select("mean_length").scalar())
            .groupBy("query_id", self.key)
            .agg(F.round(F.sum(part), digits).alias("score"))
        )


def best_matches(
    catalog: DataFrame,
    queries: DataFrame,
    index: LexicalIndex,
    n: int,
    where: Column | None = None,
    text: str = "name",
    digits: int = 9,
    checked: bool = False,
) -> DataFrame:
    """Best ``n`` matches for a table ``(query_id, text)``: ``(query_id, key, img, name, score, rank)``.

    ``where`` applies to all queries. A table with the columns of ``REQUEST_COLUMNS`` states
    conditions per query as well, in the lenient form. Statistics come from ``index``; names are
    scored where they lie, a slice of queries at a time, so frequent terms do not make the shuffle
    grow: listing every match of every query would.
    """
    if not checked:
        refuse_repeated(queries)
    own = own_conditions(queries)
    read = ["_tokens", *(FILTER_COLUMNS if own else ())]
    rows = catalog if where is None else catalog.filter(where)
    rows = rows.select(index.key, "img", "name", tokens(F.col(text)).alias("_tokens"), *read[1:])
    wanted = query_terms(queries)
    _, terms = index._read_for(wanted.select("term").distinct())
    corpus = index.corpus.first()
    grouped = (
        index.weights(wanted, terms, F.lit(corpus["docs"]))
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("term", "weight")).alias("weights"))
    )
    requests = grouped.join(queries.select("query_id", *own), "query_id") if own else grouped
    slices = (
        (found, _relevance([r["weights"] for r in found], corpus["mean_length"], digits))
        for found in query_slices(requests, MAX_QUERIES_PER_PASS, checked=True)
    )
    id_type = queries.schema["query_id"].dataType
    return best_per_query(rows, read, slices, id_type, n, index.key, strict=False)


def _relevance(queries: list[list[Row]], mean_length: float, digits: int) -> BlockScorer:
    words = sorted({w["term"] for weights in queries for w in weights})
    place = {word: i for i, word in enumerate(words)}
    at = [(place[w["term"]], q, w["weight"]) for q, weights in enumerate(queries) for w in weights]
    term, query, weight = (np.array(x) for x in zip(*at))
    count = len(queries)

    def score(block: pa.Table) -> np.ndarray:
        lists = block["_tokens"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(words)), -1).to_numpy()
        rows = np.repeat(np.arange(len(lengths)), lengths)[found >= 0]
        # Only the terms that this block contains take part in the product.
        present, column = np.unique(found[found >= 0], return_inverse=True)
        width = len(present)
        tf = np.bincount(rows * width + column, minlength=len(lengths) * width)
        tf = tf.reshape(len(lengths), width).astype(np.float64)
        scale = BM25_K1 * (1 - BM25_B + BM25_B * lengths / mean_length)
        used = np.isin(term, present)
        weights = np.zeros((width, count))
        weights[np.searchsorted(present, term[used]), query[used]] = weight[used]
        scores = np.divide(tf, tf + scale[:, None]) @ weights
        return np.where(scores > 0, np.round(scores, digits), -np.inf)

    return score


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """``(query_id, term, repeats)`` of a table of query texts."""
    return (
        queries.select("query_id", F.explode(tokens(F.col(text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )

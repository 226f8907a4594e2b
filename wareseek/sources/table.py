"""The enriched catalog as Parquet files: insert, upsert and reset by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wareseek.operators.ranking import keep_last
from wareseek.schemas import ENRICHED_CATALOG, MODEL_BATCH_SIZE
from wareseek.storage import is_small, materialise

_BUCKET = "_bucket"
# An update this small is broadcast to the stored rows, so that those are not shuffled at all.
MAX_BROADCAST_UPDATES = 5_000


class DuplicateKeyError(ValueError):
    """A key that must be new or unique is not."""


def write_search_layout(catalog: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Lay a catalog out for searching: rows with the same facets and ratings lie together.

    Range partitioning by facet and rating lets the scan skip row groups by their statistics. The
    key ends the range, so a category that holds a third of all rows still spreads over its share
    of files. ``partition_by`` adds folders for facets that nearly every search names.
    """
    order = [*partition_by, *[c for c in ("category", "season", "color") if c not in partition_by]]
    ranges = [*[F.col(c) for c in order], F.col("rating").desc(), F.col("_id")]
    laid_out = catalog.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    laid_out.write.partitionBy(*partition_by).parquet(path)


def merge_updates(
    stored: DataFrame, incoming: DataFrame, key: str = "_id", broadcast: bool = False
) -> DataFrame:
    """``stored`` with ``incoming`` applied, in the columns of ``stored``.

    A matched row takes every incoming column, NULLs included, and keeps its others; an unmatched
    incoming row is added. Keys are unique on both sides. The choice goes by a match flag, since
    an incoming NULL has to win. With ``broadcast`` the stored side is only scanned. Incoming rows
    that have all columns are not joined at all; only their keys are.
    """
    if set(incoming.columns) >= set(stored.columns):
        keys = incoming.select(key)
        kept = stored.join(F.broadcast(keys) if broadcast else keys, key, "left_anti")
        return kept.select(*stored.columns).unionByName(incoming.select(*stored.columns))
    given = [c for c in incoming.columns if c != key]
    flagged = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    columns = [pick(c) if c in given else F.col(c) for c in stored.columns]
    if not broadcast:
        return stored.join(flagged, key, "full").select(*columns)
    updated = stored.join(F.broadcast(flagged), key, "left").select(*columns)
    matched = stored.select(key).join(F.broadcast(incoming.select(key)), key, "left_semi")
    added = incoming.join(F.broadcast(matched), key, "left_anti")
    return updated.unionByName(added, allowMissingColumns=True)


def duplicated_keys(df: DataFrame, key: str = "_id") -> DataFrame:
    """Keys that occur more than once, or are missing. Copies are counted within each task first."""
    return df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull())


class CatalogTable:
    """Parquet files in ``buckets`` folders by key hash.

    An update rewrites only the buckets its keys fall into. Choose ``buckets`` so that one bucket
    is a few gigabytes; within a bucket, files are balanced by size.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType = ENRICHED_CATALOG,
        key: str = "_id",
        buckets: int = 16,
    ) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        hashed = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets))
        return df.withColumn(_BUCKET, hashed.cast("int"))

    def _conform(self, df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        """The columns of the table in its types; ``more`` columns stay as they are."""
        unknown = [c for c in df.columns if c not in (*self.schema.fieldNames(), *more)]
        if unknown:
            raise ValueError(f"not columns of the table: {unknown}")
        return df.select(*[F.col(c) if c in more else F.col(c).cast(self.schema[c].dataType) for c in df.columns])

    def _staged(
        self,
        df: DataFrame,
        order: Sequence[str] | None = None,
        write: Callable[[DataFrame], DataFrame] = partial(materialise, name="staged"),
    ) -> DataFrame:
        """Rows in the columns of the table with their buckets, written once and read back by ``write``.

        A missing or repeated key is an error. With ``order`` the last of several rows for one key is kept instead.
        Keys are counted on the staged copy, so rows are sorted by key only where one is repeated.
        """
        places = {}
        if order is not None:
            # By the values as they came; a column without a type has none to go by.
            places = {f"_order_{i}": c for i, c in enumerate(order) if not isinstance(df.schema[c].dataType, T.NullType)}
            df = df.withColumns({place: F.col(c) for place, c in places.items()})
            df = df.drop(*[c for c in order if c not in self.schema.fieldNames()])
        staged = write(self._bucketed(self._conform(df, tuple(places))))
        wrong = [r[0] for r in duplicated_keys(staged, self.key).select(self.key).orderBy(self.key).limit(5).collect()]
        if wrong and (order is None or wrong[0] is None):
            raise DuplicateKeyError(f"keys missing or repeated: {wrong}")
        if wrong:
            staged = write(keep_last(staged, [self.key], list(places)))
        return staged.drop(*places)

    def _is_small(self, staged: DataFrame, max_rows: int) -> bool:
        """As ``is_small``; rows are counted first, without their columns, so no long content is brought together for it."""
        return staged.limit(max_rows + 1).count() <= max_rows and is_small(staged, max_rows)

    def _with_buckets(self) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField(_BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _touched_by(self, staged: DataFrame) -> DataFrame:
        """The stored rows of the buckets that incoming keys fall into."""
        touched = [r[0] for r in staged.select(_BUCKET).distinct().collect()]
        return self._with_buckets().filter(F.col(_BUCKET).isin(touched))

    def read(self) -> DataFrame:
        return self._with_buckets().drop(_BUCKET)

    def reset(self) -> None:
        """Leave an empty table."""
        empty = self._bucketed(self.spark.createDataFrame([], self.schema))
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            _BUCKET
        ).parquet(self.path)

    def _write(
        self, df: DataFrame, mode: str, rebalance: bool = True, overwrites: str = "dynamic"
    ) -> None:
        (
            (df.hint("rebalance", _BUCKET) if rebalance else df)
            .write.mode(mode)
            .option("partitionOverwriteMode", overwrites)
            .partitionBy(_BUCKET)
            .parquet(self.path)
        )

    def replace(self, df: DataFrame) -> None:
        """Put new rows in place of all stored ones; a repeated or missing key changes nothing."""
        staged = materialise(self._bucketed(self._conform(df)), "replacement")
        taken = duplicated_keys(staged, self.key).select(self.key).limit(5).collect()
        if taken:
            raise DuplicateKeyError(f"keys missing or repeated: {[r[0] for r in taken]}")
        self._write(staged, "overwrite", overwrites="static")

    def insert(self, df: DataFrame) -> None:
        """Append new rows; a key that is repeated, missing or already stored is an error."""
        staged = materialise(self._bucketed(self._conform(df)), "insert")
        stored = self._touched_by(staged).select(self.key)
        clashes = stored.join(staged.select(self.key), self.key, "left_semi")
        taken = duplicated_keys(staged, self.key).select(self.key).limit(5).collect()
        taken += clashes.limit(5).collect()
        if taken:
            raise DuplicateKeyError(f"keys missing, repeated or already stored: {[r[0] for r in taken]}")
        self._write(staged, "append")

    def upsert(self, df: DataFrame, order: Sequence[str] | None = None) -> None:
        """Apply updates by key.

        Keys must be unique, unless ``order`` names the columns that decide which of several rows
        for one key comes last and so wins. Columns used only for that need not be in the table.
        """
        staged = self._staged(df, order)
        small = self._is_small(staged, MAX_BROADCAST_UPDATES)
        merged = merge_updates(self._touched_by(staged), staged, self.key, broadcast=small)
        # A dynamic overwrite stages the new buckets and swaps them in when the job commits, so the
        # old ones can be read, and re-read after a lost executor, until then. Applying the same
        # updates again gives the same table.
        # A small update leaves stored rows where they were read, so they are not shuffled.
        self._write(merged, "overwrite", rebalance=not small)


def write_batches(
    df: DataFrame,
    make_writer: Callable[[], Callable[[list[dict]], None]],
    batch_size: int = MODEL_BATCH_SIZE,
    concurrency: int = 10,
) -> int:
    """Send rows to an external store in batches, from at most ``concurrency`` writers at a time.

    A writer is made per task and called with lists of documents. Returns the number of rows
    written. A task that is retried sends its batches again, so writers should upsert.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write, written = make_writer(), 0
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                documents = batch.iloc[at : at + batch_size].to_dict(orient="records")
                write(documents)
                written += len(documents)
        yield pd.DataFrame({"written": [written]})

    # An exchange, not a coalesce: the work before it keeps its own number of tasks.
    counts = df.repartition(concurrency).mapInPandas(run, "written long")
    return counts.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]

"""Incremental updates: new raw files are enriched and upserted as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from wareseek.operators.text_index import TextIndex
from wareseek.plans.enrich import enrich_into
from wareseek.schemas import RAW_CATALOG
from wareseek.sources.csv import stream_catalog_csv
from wareseek.sources.table import CatalogTable
from wareseek.sources.versions import VersionedTable


def start_updates(
    spark: SparkSession,
    source: str,
    table: CatalogTable,
    enrich: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    schema: T.StructType = RAW_CATALOG,
    files_per_batch: int = 1_000,
    file_format: Literal["parquet", "csv"] = "parquet",
    key: str = "name",
    index: TextIndex | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Watch a folder of raw Parquet or CSV files; each micro-batch updates the table.

    Of several raw rows for one ``key`` only the last by ``id`` is enriched, so no model runs for a row that would be
    overwritten at once. Staged copies of a batch are removed with it. A batch that is repeated after a failure changes nothing, because updates go by key. A
    :class:`VersionedTable` publishes the batch's number with its rows, under the name of the checkpoint, and a
    repeated batch then runs no model either. A text index of such a table follows each batch. Without a trigger, everything present is processed and the query ends.
    """
    if file_format == "csv":
        arrivals = stream_catalog_csv(spark, source, schema, files_per_batch=files_per_batch)
    else:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        arrivals = reader.parquet(source)

    def apply(batch: DataFrame, batch_id: int) -> None:
        number = (checkpoint, batch_id) if isinstance(table, VersionedTable) else None
        enrich_into(table, batch, enrich, "update", key, batch=number, index=index)

    return (
        arrivals.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

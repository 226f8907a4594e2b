"""Product pictures: fetched over the network or joined from stored files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def http_get(url: str, timeout: float = 30.0) -> bytes:
    with urlopen(url, timeout=timeout) as response:
        return response.read()


def fetch_assets(
    df: DataFrame,
    fetch: Callable[[str], bytes] = http_get,
    url: str = "url",
    asset: str = "img",
    threads: int = 16,
    batch_size: int = 256,
) -> DataFrame:
    """Add the bytes behind each URL; any failure gives empty bytes.

    Calls overlap in a thread pool within the task, and at most ``batch_size`` assets are held at
    a time.
    """

    def guarded(address: str) -> bytes:
        try:
            return fetch(address)
        except Exception:
            return b""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for at in range(0, len(batch), batch_size):
                    part = batch.iloc[at : at + batch_size]
                    yield part.assign(**{asset: list(pool.map(guarded, part[url]))})

    fields = [f for f in df.schema if f.name != asset]
    schema = T.StructType([*fields, T.StructField(asset, T.BinaryType())])
    return df.select(*[f.name for f in fields]).mapInPandas(run, schema)


def read_stored_assets(spark: SparkSession, path: str) -> DataFrame:
    """``(url, img)`` from a folder of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("url"), F.col("content").alias("img"))


def join_assets(df: DataFrame, assets: DataFrame, url: str = "url", asset: str = "img") -> DataFrame:
    """Add stored bytes by URL; a product without a file gets empty bytes.

    A plain equi-join on the left side's URL: when very many products share one address, adaptive
    execution splits their side of the join.
    """
    known = assets.select(F.col(url), F.col(asset))
    joined = df.drop(asset).join(known, url, "left")
    return joined.withColumn(asset, F.coalesce(asset, F.lit(b"")))


def has_asset(asset: str = "img") -> Column:
    """True for rows with a non-empty asset."""
    return F.length(asset) > 0

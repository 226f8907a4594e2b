"""The raw product catalog as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wareseek.schemas import NULL_TOKENS, RAW_CATALOG
from wareseek.sources.records import parse_records, read_records

_READING = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "enforceSchema": False,
    "mode": "FAILFAST",
}


def read_catalog_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_CATALOG,
    multiline: bool = True,
    limit: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Typed catalog rows. Columns outside ``schema`` are kept as text.

    Text keeps empty values; a number column reads the usual missing-value tokens as NULL and
    fails on anything else that is not a number. Values may span lines, which ties a file to one
    task: at scale, ship many files, read large ones by :func:`read_catalog_csv_split`, or pass
    ``multiline=False`` when no value contains a newline. ``partitions`` spreads the rows for the stages that follow and
    never changes how many there are; ``limit`` does.
    """
    df = _typed_rows(spark.read.options(**_READING, multiLine=multiline).csv(path), schema)
    if limit is not None:
        df = df.limit(limit)
    return df if partitions is None else df.repartition(partitions)


def read_catalog_csv_split(spark: SparkSession, path: str, schema: T.StructType = RAW_CATALOG) -> DataFrame:
    """The rows of :func:`read_catalog_csv`, with files that hold multi-line values read by many tasks.

    Reads the files three times. All must have the header of the first; ``read_records`` says what is refused.
    Values keep their line breaks; the reader of whole files turns CR LF inside values to LF where lines
    end in CR LF.
    """
    names = spark.read.options(**_READING, multiLine=True).csv(path).columns
    reading = {k: str(v) for k, v in _READING.items() if k not in ("header", "enforceSchema")}
    rows = parse_records(read_records(spark, path), names, {**reading, "multiLine": "true"})
    return _typed_rows(rows, schema)


def stream_catalog_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_CATALOG,
    multiline: bool = True,
    files_per_batch: int = 1_000,
) -> DataFrame:
    """A stream of the rows of CSV files as they arrive, typed as by :func:`read_catalog_csv`.

    A stream's columns must be known beforehand, so headers have to match ``schema``.
    """
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    reader = spark.readStream.schema(strings).options(**_READING, multiLine=multiline)
    return _typed_rows(reader.option("maxFilesPerTrigger", files_per_batch).csv(path), schema)


def write_catalog_csv(df: DataFrame, path: str) -> None:
    """CSV files that :func:`read_catalog_csv` reads back unchanged."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def _typed_rows(text: DataFrame, schema: T.StructType) -> DataFrame:
    types = {f.name: f.dataType for f in schema}
    return text.select(*[_typed(c, types.get(c, T.StringType())).alias(c) for c in text.columns])


def _typed(name: str, kind: T.DataType) -> Column:
    text = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        # The reader gives NULL for an empty cell; in a text column that is an empty text.
        return F.coalesce(text, F.lit(""))
    number = F.when(~text.isin(*NULL_TOKENS), text).cast(kind)
    return F.when(~F.isnan(number), number) if isinstance(kind, T.DoubleType) else number

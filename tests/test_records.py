"""Multi-line CSV by splits, and the sink as a data source."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from wareseek.sources.csv import read_catalog_csv, read_catalog_csv_split
from wareseek.sources.records import UnbalancedQuotesError, read_records
from wareseek.sources.sink import JsonFolder, Sent, _Writer, register_sink, send

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType())])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def written(tmp_path, *files):
    for i, text in enumerate(files):
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
    return str(tmp_path)


NOTES = ["plain", "two\nlines", 'a "quoted" word', "", "comma, and\r\nreturn", '"', "\n\n", "é" * 40, "x\n" * 300]


def quoted(notes, end="\n"):
    cells = [n.replace('"', '""') for n in notes]
    return f"id,note{end}" + "".join(f'{i},"{c}"{end}' for i, c in enumerate(cells))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_records_equal_the_reader(spark, tmp_path, small_splits, end):
    path = written(tmp_path, quoted(NOTES * 7, end), quoted(["one"], end), quoted([], end), quoted(NOTES[::-1], end)[: -len(end)])
    whole = read_catalog_csv(spark, path, SCHEMA)
    split = read_catalog_csv_split(spark, path, SCHEMA)
    assert split.count() == 7 * len(NOTES) + 1 + len(NOTES)
    assert split.where(F.col("note") == NOTES[5 - 1]).count() == 8
    if end == "\r\n":  # the whole reader alters line breaks inside values to line feeds
        split = split.withColumn("note", F.regexp_replace("note", "\r\n", "\n"))
    assert rows_of(split) == rows_of(whole)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = written(tmp_path, quoted(NOTES * 7))
    assert read_catalog_csv(spark, path, SCHEMA).rdd.getNumPartitions() == 1
    found = read_records(spark, path).groupBy("split").count().collect()
    assert len(found) > 10


def test_splits_too_many_to_broadcast(spark, tmp_path, small_splits, monkeypatch):
    path = written(tmp_path, quoted(NOTES * 7), quoted(NOTES))
    broadcast = rows_of(read_catalog_csv_split(spark, path, SCHEMA))
    monkeypatch.setattr("wareseek.sources.records.MAX_BROADCAST_SPLITS", 1)
    assert rows_of(read_catalog_csv_split(spark, path, SCHEMA)) == broadcast


def test_refused_files(spark, tmp_path, small_splits):
    with pytest.raises(UnbalancedQuotesError):
        read_catalog_csv_split(spark, written(tmp_path, 'id,note\n1,"open\n'), SCHEMA)
    mixed = written(tmp_path, "id,note\n1,a\n", "note,id\na,1\n")
    with pytest.raises(PySparkException, match="has another header"):
        read_catalog_csv_split(spark, mixed, SCHEMA).collect()


def test_empty_lines_and_marks(spark, tmp_path, small_splits):
    path = written(tmp_path, "﻿id,note\n\n1,a\n\n\n2,b\n\n")
    assert rows_of(read_catalog_csv_split(spark, path, SCHEMA)) == [(1, "a"), (2, "b")]


def test_sink_publishes_each_document_once(spark, tmp_path):
    store = JsonFolder(str(tmp_path / "store"))
    register_sink(spark, "test_sink", store)
    rows = spark.range(1_003).withColumn("name", F.concat(F.lit("n"), "id"))
    send(rows, "test_sink", batch_size=50, concurrency=4)
    back = spark.read.schema(rows.schema).json(store.path)
    assert rows_of(back) == rows_of(rows) and store.published() == 1_003
    sizes = [sum(1 for _ in open(os.path.join(store.path, f))) for f in os.listdir(store.path) if not f.startswith("_")]
    assert max(sizes) == 50 and len([s for s in sizes if s < 50]) <= 4
    send(rows.limit(7), "test_sink", mode="overwrite")
    assert spark.read.schema(rows.schema).json(store.path).count() == 7 == store.published()
    send(rows.limit(0), "test_sink")
    assert store.published() == 7


def test_sink_attempts_that_do_not_count(tmp_path):
    """A task that fails half way and is retried, and one that runs twice."""
    store = JsonFolder(str(tmp_path))
    writer = _Writer(store, 2, False)
    batch = pa.RecordBatch.from_pylist([{"id": i} for i in range(5)])

    def lost():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    retried, twice = writer.write(iter([batch])), writer.write(iter([batch]))
    assert retried.documents == twice.documents == 5 and retried.batches == 3
    writer.commit([retried, None])
    ids = [json.loads(line)["id"] for f in os.listdir(tmp_path) if not f.startswith("_") for line in open(tmp_path / f)]
    assert sorted(ids) == list(range(5)) and store.published() == 5
    assert not [f for f in os.listdir(tmp_path) if f.startswith("_staged")]


class Refusing(JsonFolder):
    def stage(self, job: str, attempt: str, number: int, documents: list[dict]) -> None:
        if any(d["id"] == 700 for d in documents):
            raise OSError("refused")
        super().stage(job, attempt, number, documents)


def test_sink_aborts(spark, tmp_path):
    store = Refusing(str(tmp_path / "store"))
    register_sink(spark, "refusing_sink", store)
    with pytest.raises(PySparkException):
        send(spark.range(1_000), "refusing_sink", batch_size=10, concurrency=4)
    left = os.listdir(store.path) if os.path.isdir(store.path) else []
    assert not [f for f in left if not f.startswith("_staged")] and store.published() == 0


def test_sent_counts():
    assert Sent("a", 1, 1) == Sent("a", 1, 1)

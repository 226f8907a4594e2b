"""Documents to an external store through Spark's writer interface: staged by tasks, published by the job."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wareseek.schemas import MODEL_BATCH_SIZE


@dataclass
class Sent(WriterCommitMessage):
    """What one attempt of a task staged."""

    attempt: str
    documents: int
    batches: int


class Store(ABC):
    """A store that keeps documents aside until a job is known to have succeeded.

    It is sent to executors, so it holds addresses and no connections. ``job`` names the write,
    ``attempt`` one attempt of one task; a task that is retried or runs twice has several.
    """

    @abstractmethod
    def stage(self, job: str, attempt: str, number: int, documents: list[dict]) -> None:
        """Put one batch aside."""

    @abstractmethod
    def publish(self, job: str, sent: list[Sent], overwrite: bool) -> None:
        """Make the batches of these attempts visible, and no others."""

    @abstractmethod
    def discard(self, job: str) -> None:
        """Forget whatever the job put aside."""


class _Writer(DataSourceArrowWriter):
    def __init__(self, store: Store, batch_size: int, overwrite: bool) -> None:
        self.store, self.batch_size, self.overwrite, self.job = store, batch_size, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        sent = Sent(uuid.uuid4().hex, 0, 0)
        waiting: list[dict] = []

        def stage(documents: list[dict]) -> None:
            self.store.stage(self.job, sent.attempt, sent.batches, documents)
            sent.documents += len(documents)
            sent.batches += 1

        for batch in iterator:
            for at in range(0, batch.num_rows, self.batch_size):
                waiting += batch.slice(at, self.batch_size).to_pylist()
                if len(waiting) >= self.batch_size:
                    stage(waiting[: self.batch_size])
                    waiting = waiting[self.batch_size :]
        if waiting:
            stage(waiting)
        return sent

    def commit(self, messages: list[Sent | None]) -> None:
        self.store.publish(self.job, [m for m in messages if m is not None], self.overwrite)
        self.store.discard(self.job)

    def abort(self, messages: list[Sent | None]) -> None:
        self.store.discard(self.job)


def register_sink(spark: SparkSession, name: str, store: Store) -> None:
    """Makes ``df.write.format(name).mode("append" or "overwrite").save()`` write to ``store``.

    Documents reach the store in batches of the option ``batch_size``. One attempt per task counts:
    the store publishes the attempts that Spark committed, so a task that is retried after a lost
    executor, or runs twice, leaves its documents once; a job that fails publishes none.
    """

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> _Writer:
            size = int(self.options.get("batch_size", MODEL_BATCH_SIZE))
            if size < 1:
                raise ValueError("batch_size must be at least 1")
            return _Writer(store, size, overwrite)

    spark.dataSource.register(Sink)


def send(df: DataFrame, name: str, batch_size: int = MODEL_BATCH_SIZE, concurrency: int = 10, mode: str = "append") -> None:
    """Write through a registered sink from ``concurrency`` tasks; the stages before keep their own number."""
    df.repartition(concurrency).write.format(name).option("batch_size", batch_size).mode(mode).save()


class JsonFolder(Store):
    """Files of JSON lines in a folder that all executors share, one for each batch.

    Batches wait in a folder of the job and are renamed into place when it commits. The name holds the
    job, so a commit that is interrupted shows which files belong to it; a reader that must not see
    them half reads the files that ``_published-<job>.json`` lists.
    """

    def __init__(self, path: str) -> None:
        self.path = urlparse(path).path

    def _staged(self, job: str) -> str:
        return os.path.join(self.path, f"_staged-{job}")

    def stage(self, job: str, attempt: str, number: int, documents: list[dict]) -> None:
        os.makedirs(self._staged(job), exist_ok=True)
        with open(os.path.join(self._staged(job), f"{attempt}-{number}.json"), "w") as out:
            out.writelines(json.dumps(d, default=str) + "\n" for d in documents)

    def publish(self, job: str, sent: list[Sent], overwrite: bool) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [f for f in os.listdir(self.path) if f.endswith(".json")] if overwrite else []
        files = [f"{s.attempt}-{n}.json" for s in sent for n in range(s.batches)]
        for name in files:
            os.replace(os.path.join(self._staged(job), name), os.path.join(self.path, f"{job}-{name}"))
        listing = {"files": [f"{job}-{f}" for f in files], "documents": sum(s.documents for s in sent)}
        with open(os.path.join(self.path, f"_published-{job}.json"), "w") as out:
            json.dump(listing, out)
        for name in old:
            os.remove(os.path.join(self.path, name))

    def discard(self, job: str) -> None:
        shutil.rmtree(self._staged(job), ignore_errors=True)

    def published(self) -> int:
        """How many documents the folder holds, from the listings of the jobs that committed."""
        found = [f for f in os.listdir(self.path) if f.startswith("_published-")] if os.path.isdir(self.path) else []
        return sum(json.load(open(os.path.join(self.path, f)))["documents"] for f in found)

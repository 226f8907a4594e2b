"""Versioned folders: a table whose updates readers see whole or not at all, and its small updates as deltas.

Data files are never changed. A write adds folders and then publishes a new version, a manifest of a
few rows that says which folders make up the table. A manifest is one file and appears at once, so a
reader sees the version before or the version after. A writer that dies before it publishes leaves folders
nobody lists; ``expire`` removes those, and old versions, after a grace period.

A small update writes only its own rows, complete after the merge, as a delta that readers put over the stored
buckets. ``compact`` folds deltas into the buckets they fall into. A large update rewrites the buckets
it touches. Either way the other buckets keep their files.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from wareseek.operators.ranking import keep_last
from wareseek.sources.table import _BUCKET, CatalogTable, DuplicateKeyError, merge_updates
from wareseek.storage import delete_folder, list_folders

# An update this small becomes a delta; its keys are broadcast to readers.
MAX_DELTA_ROWS = 50_000
# With so many deltas, the next update folds them first.
MAX_DELTAS = 8
_SEQ = "_seq"
_ENTRY = "role string, bucket int, folder string, seq long"


class ConcurrentWriteError(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Manifest:
    """The versions of a set of folders, each a file with one row for every folder in use."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_ENTRY}, version long").json(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def versions(self) -> list[int]:
        rows = self._rows()
        return [] if rows is None else sorted(r[0] for r in rows.select("version").distinct().collect())

    def entries(self, version: int) -> list[Row]:
        """One row for each folder: as many as there are buckets and deltas."""
        rows = self._rows()
        if rows is None:
            return []
        return rows.filter((F.col("version") == version) & (F.col("role") != "head")).drop("version").collect()

    def latest(self) -> tuple[int, list[Row]]:
        """The newest version and its rows; 0 and none before anything was published."""
        versions = self.versions()
        return (versions[-1], self.entries(versions[-1])) if versions else (0, [])

    def publish(self, version: int, entries: Sequence[Row | tuple]) -> None:
        """Make ``version`` the newest. Its folders must be complete by now."""
        rows = [("head", None, None, version), *[tuple(e) for e in entries]]
        target = f"{self.path}/version={version:012d}"
        try:
            self.spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("error").json(target)
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise ConcurrentWriteError(f"version {version} exists") from error

    def expire(self, data: str, keep: int, grace_seconds: float) -> None:
        """Forget all but the newest ``keep`` versions, and remove folders below ``data`` that none of those uses.

        What is younger than ``grace_seconds`` stays: a reader or a writer may be at work on it.
        """
        kept = self.versions()[-keep:]
        used = {e["folder"] for v in kept for e in self.entries(v)}
        before = time.time() - grace_seconds
        for name, changed in list_folders(self.spark, self.path):
            if name.startswith("version=") and int(name[8:]) not in kept and changed < before:
                delete_folder(self.spark, f"{self.path}/{name}")
        still = {e["folder"] for v in self.versions() for e in self.entries(v)}
        for name, changed in list_folders(self.spark, data):
            if name not in used | still and changed < before:
                delete_folder(self.spark, f"{data}/{name}")


class VersionedTable(CatalogTable):
    """A :class:`CatalogTable` in versioned folders."""

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.path}/manifest")

    def _folder(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def _rows(self, entries: list[Row], buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets only if they are named."""
        base = [e for e in entries if e["role"] == "base" and (buckets is None or e["bucket"] in buckets)]
        paths = [f"{self._folder(e['folder'])}/{_BUCKET}={e['bucket']}" for e in base]
        # With the limit it is known to be empty before anything runs, so no join with it does.
        empty = self.spark.createDataFrame([], self.schema).limit(0)
        stored = self.spark.read.schema(self.schema).parquet(*paths) if paths else empty
        changed = self._changed(entries)
        if changed is None:
            return stored
        newest = keep_last(changed, [self.key], [_SEQ]).drop(_SEQ)
        if buckets is not None:
            newest = self._bucketed(newest).filter(F.col(_BUCKET).isin(list(buckets))).drop(_BUCKET)
        # Bounded: MAX_DELTAS deltas of at most MAX_DELTA_ROWS rows.
        keys = F.broadcast(changed.select(self.key).distinct())
        return stored.join(keys, self.key, "left_anti").unionByName(newest)

    def _changed(self, entries: list[Row]) -> DataFrame | None:
        """All rows of all deltas, with the order of the deltas."""
        read = lambda e: self.spark.read.schema(self.schema).parquet(self._folder(e["folder"])).withColumn(_SEQ, F.lit(e["seq"]))
        deltas = [read(e) for e in entries if e["role"] == "delta"]
        return reduce(DataFrame.unionAll, deltas) if deltas else None

    def _write_buckets(self, rows: DataFrame, name: str | None = None) -> list[tuple]:
        """Write rows to a folder of their own, or add them to one that no version lists yet; the manifest rows of its buckets."""
        name = name or uuid.uuid4().hex
        self._bucketed(rows).hint("rebalance", _BUCKET).write.mode("append").partitionBy(_BUCKET).parquet(self._folder(name))
        return self._buckets_of(name)

    def _written(self, df: DataFrame, order: Sequence[str] | None = None) -> tuple[str, DataFrame]:
        """Rows staged in buckets, so that a version can list them where they are: the folder's name, and the rows.

        Columns that only order rows stay in the files; nobody reads them.
        """
        names: list[str] = []

        def write(rows: DataFrame) -> DataFrame:
            names.append(uuid.uuid4().hex)
            self._write_buckets(rows, names[-1])
            return self.spark.read.schema(rows.schema).parquet(self._folder(names[-1]))

        try:
            staged = self._staged(df, order, write)
        except Exception:
            self._discard(names)
            raise
        self._discard(names[:-1])
        return names[-1], staged

    def _discard(self, names: Sequence[str]) -> None:
        for name in names:
            delete_folder(self.spark, self._folder(name))

    def _buckets_of(self, name: str) -> list[tuple]:
        """The manifest rows of a folder."""
        found = [f[len(_BUCKET) + 1 :] for f, _ in list_folders(self.spark, self._folder(name)) if f.startswith(f"{_BUCKET}=")]
        return [("base", int(bucket), name, None) for bucket in sorted(found)]

    def read(self, version: int | None = None) -> DataFrame:
        """The newest rows, or those of an earlier version that has not expired."""
        return self._rows(self.manifest.latest()[1] if version is None else self.manifest.entries(version))

    def reset(self) -> None:
        self.manifest.publish(self.manifest.latest()[0] + 1, [])

    def replace(self, df: DataFrame) -> None:
        version = self.manifest.latest()[0]
        self.manifest.publish(version + 1, self._buckets_of(self._written(df)[0]))

    def insert(self, df: DataFrame) -> None:
        version, entries = self.manifest.latest()
        name, staged = self._written(df)
        touched = {r[0] for r in staged.select(_BUCKET).distinct().collect()}
        clashes = self._rows(entries, touched).join(staged.select(self.key), self.key, "left_semi")
        taken = clashes.select(self.key).limit(5).collect()
        if taken:
            self._discard([name])
            raise DuplicateKeyError(f"keys already stored: {[r[0] for r in taken]}")
        self.manifest.publish(version + 1, [*entries, *self._buckets_of(name)])

    def applied(self, writer: str) -> int:
        """The last batch that ``writer`` has published, -1 before the first."""
        return max((e["seq"] for e in self.manifest.latest()[1] if e["role"] == "batch" and e["folder"] == writer), default=-1)

    def upsert(self, df: DataFrame, order: Sequence[str] | None = None, batch: tuple[str, int] | None = None) -> None:
        """Apply updates by key, as the plain table does.

        ``batch`` names the writer and the number of its batch. It is published with the data; a number that is
        not above the last one published changes nothing.
        """
        if batch is not None and batch[1] <= self.applied(batch[0]):
            return
        # Rows with all columns take the place of stored ones as they are, so they are written where they will stay.
        whole = set(df.columns) >= set(self.schema.fieldNames())
        name, staged = self._written(df, order) if whole else (None, self._staged(df, order))
        version, entries = self.manifest.latest()
        done = [] if batch is None else [("batch", None, *batch)]
        entries = [e for e in entries if batch is None or (e["role"], e["folder"]) != ("batch", batch[0])]
        touched = {r[0] for r in staged.select(_BUCKET).distinct().collect()}
        incoming, rows = staged.drop(_BUCKET), self._rows(entries, touched)
        if self._is_small(staged, MAX_DELTA_ROWS) and sum(e["role"] == "delta" for e in entries) < MAX_DELTAS:
            matched = rows.join(F.broadcast(incoming.select(self.key)), self.key, "left_semi")
            delta = uuid.uuid4().hex
            merged = merge_updates(matched, incoming, self.key)
            merged.write.parquet(self._folder(delta))
            self._discard([name] if whole else [])
            self.manifest.publish(version + 1, [*entries, ("delta", None, delta, version + 1), *done])
        else:
            touched |= self._delta_buckets(entries)
            stored = self._rows(entries, touched)
            if whole:
                rows = stored.join(incoming.select(self.key), self.key, "left_anti")
            else:
                rows = merge_updates(stored, incoming, self.key)
            self._publish_buckets(version + 1, entries, touched, rows, done, name)

    def _delta_buckets(self, entries: list[Row]) -> set[int]:
        changed = self._changed(entries)
        return set() if changed is None else {r[0] for r in self._bucketed(changed).select(_BUCKET).distinct().collect()}

    def _publish_buckets(
        self, version: int, entries: list[Row], touched: set[int], rows: DataFrame, done: list[tuple], name: str | None = None
    ) -> None:
        """Rows, and those already in the folder ``name``, in place of the touched buckets and of all deltas."""
        kept = [e for e in entries if e["role"] == "batch" or (e["role"] == "base" and e["bucket"] not in touched)]
        self.manifest.publish(version, [*kept, *self._write_buckets(rows, name), *done])

    def compact(self) -> None:
        """Fold all deltas into the buckets they fall into; the table's rows stay the same."""
        version, entries = self.manifest.latest()
        touched = self._delta_buckets(entries)
        if touched:
            self._publish_buckets(version + 1, entries, touched, self._rows(entries, touched), [])

    def expire(self, keep: int = 2, grace_seconds: float = 86_400) -> None:
        """Remove versions but the newest ``keep``, and folders no version lists, once they are old enough."""
        self.manifest.expire(f"{self.path}/data", keep, grace_seconds)

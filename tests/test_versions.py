"""Versioned tables: what readers see while, after and instead of an update."""

import os
import random

import pytest
from pyspark.sql import functions as F

from test_tables import ITEMS, items, rows_of
from wareseek.plans.enrich import enrich_into
from wareseek.sources import versions
from wareseek.sources.table import DuplicateKeyError
from wareseek.sources.versions import ConcurrentWriteError, Manifest, VersionedTable
from wareseek.storage import materialise, scratch_root, scratch_scope
from wareseek.streaming.updates import start_updates


@pytest.fixture
def store(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "items"), ITEMS, buckets=4)


def folders(tmp_path):
    return {p.name for p in (tmp_path / "items" / "data").iterdir()}


@pytest.mark.parametrize("delta_rows", [0, 50_000])
def test_upserts_against_a_dictionary(spark, store, monkeypatch, delta_rows):
    """As deltas, as rewritten buckets, and through the folding in between."""
    monkeypatch.setattr(versions, "MAX_DELTA_ROWS", delta_rows)
    monkeypatch.setattr(versions, "MAX_DELTAS", 2)
    rng = random.Random(delta_rows)
    state = {f"k{i}": (float(i), "x") for i in range(100)}
    store.insert(items(spark, [(k, *v) for k, v in state.items()]))
    for round in range(4):
        updates = {f"k{rng.randrange(150)}": rng.choice([None, 1.5, float(round)]) for _ in range(30)}
        store.upsert(spark.createDataFrame(list(updates.items()), "_id string, price double"))
        for key, price in updates.items():
            state[key] = (price, state.get(key, (None, None))[1])
        assert rows_of(store.read()) == sorted([(k, *v) for k, v in state.items()], key=repr)
    before = rows_of(store.read())
    store.compact()
    assert rows_of(store.read()) == before
    assert not [e for e in store.manifest.latest()[1] if e["role"] == "delta"]


def test_a_writer_that_dies_before_publishing_changes_nothing(spark, store, tmp_path, monkeypatch):
    store.insert(items(spark, [("a", 1.0, "x"), ("b", 2.0, None)]))
    reader, before = store.read(), rows_of(store.read())

    def die(*_):
        raise KeyboardInterrupt

    for delta_rows in (0, 50_000):
        monkeypatch.setattr(versions, "MAX_DELTA_ROWS", delta_rows)
        with monkeypatch.context() as patch:
            patch.setattr(Manifest, "publish", die)
            with pytest.raises(KeyboardInterrupt):
                store.upsert(items(spark, [("a", 9.0, "y"), ("c", 3.0, None)]))
        assert rows_of(store.read()) == before
    assert len(folders(tmp_path)) == 3
    store.expire(grace_seconds=3_600)
    assert len(folders(tmp_path)) == 3  # young folders may belong to a writer at work
    store.expire(grace_seconds=-60)
    assert len(folders(tmp_path)) == 1 and rows_of(reader) == before
    store.upsert(items(spark, [("a", 9.0, "y")]))
    assert rows_of(store.read()) == [("a", 9.0, "y"), ("b", 2.0, None)]


def test_readers_keep_their_version_and_old_ones_expire(spark, store, tmp_path):
    store.insert(items(spark, [(f"k{i}", 1.0, None) for i in range(40)]))
    old = store.read()
    store.upsert(items(spark, [("k1", 2.0, None)]))
    store.replace(items(spark, [("z", 5.0, None)]))
    assert old.filter("price = 1.0").count() == 40
    assert store.read(2).filter("_id = 'k1'").first()["price"] == 2.0
    store.expire(keep=1, grace_seconds=-60)
    assert len(folders(tmp_path)) == 1 and store.manifest.versions() == [3]
    assert rows_of(store.read()) == [("z", 5.0, None)]
    store.reset()
    assert store.read().count() == 0


def test_a_small_update_writes_only_its_rows(spark, store, tmp_path):
    store.insert(items(spark, [(f"k{i}", 1.0, "long text " * 50 + str(i)) for i in range(2_000)]))
    files = lambda: {p: p.stat().st_size for p in (tmp_path / "items" / "data").rglob("*.parquet")}
    before = files()
    store.upsert(spark.createDataFrame([("k5", 2.0), ("new", 3.0)], "_id string, price double"))
    added = {p: size for p, size in files().items() if p not in before}
    assert set(before) <= set(files()) and sum(added.values()) < sum(before.values()) / 10
    row = store.read().filter("_id = 'k5'").first()
    assert row["price"] == 2.0 and row["extra"].endswith(" 5")
    # Folding it leaves the files of untouched buckets as they are.
    used = lambda: {(e["bucket"], e["folder"]) for e in store.manifest.latest()[1] if e["role"] == "base"}
    kept = used()
    store.compact()
    assert 2 <= len(used() & kept) < 4 and store.read().count() == 2_001


def test_a_large_update_keeps_the_other_buckets(spark, store, monkeypatch):
    monkeypatch.setattr(versions, "MAX_DELTA_ROWS", 0)
    store.insert(items(spark, [(f"k{i}", 1.0, None) for i in range(100)]))
    used = lambda: {(e["bucket"], e["folder"]) for e in store.manifest.latest()[1] if e["role"] == "base"}
    before = used()
    store.upsert(items(spark, [("k5", 2.0, None)]))
    assert len(before & used()) == 3 and len(used()) == 4


def test_refusals(spark, store):
    with pytest.raises(DuplicateKeyError):
        store.insert(items(spark, [("a", 1.0, None), ("a", 2.0, None)]))
    with pytest.raises(DuplicateKeyError):
        store.upsert(items(spark, [(None, 1.0, None)]))
    store.insert(items(spark, [("a", 1.0, None)]))
    store.upsert(items(spark, [("b", 1.0, None)]))
    for key in ("a", "b"):
        with pytest.raises(DuplicateKeyError):
            store.insert(items(spark, [(key, 2.0, None)]))
    with pytest.raises(ConcurrentWriteError):
        store.manifest.publish(2, [])
    with pytest.raises(ValueError):
        store.insert(spark.createDataFrame([("a", 1)], "_id string, other int"))


def test_a_batch_is_applied_once(spark, store):
    store.upsert(items(spark, [("a", 1.0, None)]), batch=("stream", 0))
    store.upsert(items(spark, [("a", 2.0, None)]), batch=("stream", 1))
    store.upsert(items(spark, [("a", 7.0, None)]), batch=("other", 0))
    version = store.manifest.latest()[0]
    store.upsert(items(spark, [("a", 9.0, None)]), batch=("stream", 1))
    assert store.manifest.latest()[0] == version and store.applied("stream") == 1 and store.applied("none") == -1
    store.compact()
    assert rows_of(store.read()) == [("a", 7.0, None)] and store.applied("stream") == 1


def test_last_row_of_a_hot_key_wins(spark, store):
    rows = [("hot", float(i), str(i), i) for i in range(500)] + [("b", 1.0, None, 0)]
    frame = spark.createDataFrame(rows, "_id string, price double, extra string, id int").repartition(4)
    store.upsert(frame, order=["id"])
    assert rows_of(store.read()) == [("b", 1.0, None), ("hot", 499.0, "499")]


def test_a_whole_update_is_written_once_and_not_sorted_by_key(spark, store, tmp_path, monkeypatch):
    """Rows without repeated keys need no last one, and rows with all columns stay where they were staged."""

    def refuse(*_):
        raise AssertionError("no key is repeated")

    monkeypatch.setattr(versions, "MAX_DELTA_ROWS", 0)
    monkeypatch.setattr(versions, "keep_last", refuse)
    monkeypatch.setattr("wareseek.sources.table.keep_last", refuse)
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    delivery = lambda first, price: spark.range(first, first + 100).selectExpr(
        "concat('k', id) AS _id", f"{price}D AS price", "CAST(NULL AS string) AS extra", "id"
    )
    store.upsert(delivery(0, 1.0), order=["id"])
    store.upsert(delivery(50, 2.0), order=["id"])
    expected = [(f"k{i}", 1.0 if i < 50 else 2.0, None) for i in range(150)]
    assert rows_of(store.read()) == sorted(expected, key=repr)
    assert set(os.listdir(root)) == before and len(folders(tmp_path)) == 2
    assert {e["folder"] for e in store.manifest.latest()[1]} < folders(tmp_path)


@pytest.mark.parametrize("kind", [VersionedTable, versions.CatalogTable])
@pytest.mark.parametrize("delta_rows", [0, 50_000])
def test_last_rows_go_by_the_values_that_came(spark, tmp_path, monkeypatch, kind, delta_rows):
    """Text is compared as text, also where the column becomes a number; a column of nulls decides nothing."""
    monkeypatch.setattr(versions, "MAX_DELTA_ROWS", delta_rows)
    table = kind(spark, str(tmp_path / "items"), ITEMS, buckets=2)
    table.upsert(items(spark, [("a", 5.0, "old"), ("c", 5.0, "old")]))
    rows = spark.createDataFrame([("a", "10", "x"), ("a", "9", "y"), ("b", "1", None)], "_id string, price string, extra string")
    rows = rows.withColumn("none", F.lit(None))
    table.upsert(rows, order=["none", "price"])
    assert rows_of(table.read()) == [("a", 9.0, "y"), ("b", 1.0, None), ("c", 5.0, "old")]
    before = {p for p in (tmp_path / "items").rglob("*.parquet")}
    with pytest.raises(DuplicateKeyError):
        table.upsert(spark.createDataFrame([(None, 1.0, "x", 1), ("d", 1.0, "x", 1), ("d", 2.0, "x", 2)], "_id string, price double, extra string, id int"), order=["id"])
    assert {p for p in (tmp_path / "items").rglob("*.parquet")} == before


def test_filters_reach_base_and_deltas(spark, store):
    store.insert(items(spark, [(f"k{i}", float(i), None) for i in range(100)]))
    store.upsert(items(spark, [("k5", 200.0, None)]))
    found = store.read().filter(F.col("price") > 150)
    assert [r["_id"] for r in found.collect()] == ["k5"]
    assert "PushedFilters: [IsNotNull(price), GreaterThan(price,150.0)" in found._jdf.queryExecution().executedPlan().toString()


def test_scratch_ends_with_its_scope(spark, tmp_path):
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with pytest.raises(ZeroDivisionError):
        with scratch_scope(spark):
            assert materialise(spark.range(5), "kept-short").count() == 5
            assert len(set(os.listdir(root)) - before) == 1
            1 / 0
    assert set(os.listdir(root)) == before
    materialise(spark.range(5), "outside")
    assert len(set(os.listdir(root)) - before) == 1


RAW = "id long, name string, price double"


def models(spark, calls):
    """Enrichment that counts the rows it is asked about, each in a staged pass of its own."""

    def enrich(raw):
        staged = materialise(raw, "descriptions")
        calls.append(staged.count())
        return staged.selectExpr("name AS _id", "price", "concat('about ', name) AS extra", "id")

    return enrich


@pytest.mark.parametrize("kind", [VersionedTable, versions.CatalogTable])
def test_keys_are_checked_before_models_run(spark, tmp_path, kind):
    table, calls = kind(spark, str(tmp_path / "items"), ITEMS, buckets=2), []
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    raw = lambda *rows: spark.createDataFrame(list(rows), RAW)
    with pytest.raises(DuplicateKeyError):
        enrich_into(table, raw((1, "a", 1.0), (2, "a", 2.0)), models(spark, calls), "first_run")
    assert calls == []
    enrich_into(table, raw((1, "a", 1.0), (2, "b", 2.0)), models(spark, calls), "first_run")
    copies = [(i, "a", float(i)) for i in range(50)] + [(7, "c", 7.0)]
    got = enrich_into(table, raw(*copies), models(spark, calls), "update")
    assert calls == [2, 2]
    assert rows_of(got) == [("a", 49.0, "about a"), ("b", 2.0, "about b"), ("c", 7.0, "about c")]
    with pytest.raises(DuplicateKeyError):
        enrich_into(table, raw((1, None, 1.0)), models(spark, calls), "update")
    assert set(os.listdir(root)) == before  # what was staged is gone, after failures as well


def test_a_replayed_batch_runs_no_model(spark, store, tmp_path):
    calls, source = [], str(tmp_path / "arrivals")
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    for i, name in enumerate("ab"):
        spark.createDataFrame([(i, name, 1.0)], RAW).write.mode("append").parquet(source)
        start_updates(spark, source, store, models(spark, calls), str(tmp_path / "check"), schema=RAW).awaitTermination()
    assert calls == [1, 1] and store.applied(str(tmp_path / "check")) == 1
    # As after a crash between the table and the stream's own record of the batch.
    commit = tmp_path / "check" / "commits" / "1"
    commit.unlink()
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    version = store.manifest.latest()[0]
    start_updates(spark, source, store, models(spark, calls), str(tmp_path / "check"), schema=RAW).awaitTermination()
    assert calls == [1, 1] and store.manifest.latest()[0] == version and commit.exists()
    assert rows_of(store.read()) == [("a", 1.0, "about a"), ("b", 1.0, "about b")]
    assert set(os.listdir(root)) == before

import random

import pytest
from pyspark.sql import functions as F

from registry.enrich import StubClient, make_classifier, make_describer
from wareseek.operators.inference import infer, with_retries
from wareseek.plans.enrich import OfflineModels, enrich_offline, enrich_online, load, token_budgets
from wareseek.schemas import RAW_CATALOG
from wareseek.sources import table as table_module
from wareseek.sources.assets import fetch_assets, has_asset, join_assets, read_stored_assets
from wareseek.sources.csv import read_catalog_csv
from wareseek.sources.table import CatalogTable, DuplicateKeyError, duplicated_keys, merge_updates, write_batches, write_search_layout
from wareseek.storage import is_small, materialise, rows_if_at_most
from wareseek.streaming.updates import start_updates
from pyspark.sql import types as T

ITEMS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("extra", T.StringType())])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


@pytest.fixture
def store(spark, tmp_path):
    return CatalogTable(spark, str(tmp_path / "items"), ITEMS, buckets=4)


@pytest.mark.parametrize("broadcast", [False, True])
def test_merge_rules(spark, broadcast):
    stored = items(spark, [("a", 1.0, "keep"), ("b", 2.0, "same")])
    incoming = spark.createDataFrame([("a", None), ("c", 3.0)], "_id string, price double")
    merged = merge_updates(stored, incoming, broadcast=broadcast)
    assert rows_of(merged) == [("a", None, "keep"), ("b", 2.0, "same"), ("c", 3.0, None)]


@pytest.mark.parametrize("limit", [0, 5_000])
def test_upsert_random(spark, store, monkeypatch, limit):
    monkeypatch.setattr(table_module, "MAX_BROADCAST_UPDATES", limit)
    rng = random.Random(limit)
    state = {f"k{i}": (float(i), "x") for i in range(200)}
    store.insert(items(spark, [(k, *v) for k, v in state.items()]))
    for _ in range(2):
        updates = {f"k{rng.randrange(300)}": rng.choice([None, 1.5]) for _ in range(60)}
        frame = spark.createDataFrame(list(updates.items()), "_id string, price double")
        store.upsert(frame)
        for key, price in updates.items():
            state[key] = (price, state.get(key, (None, None))[1])
        want = sorted([(k, *v) for k, v in state.items()], key=repr)
        assert rows_of(store.read()) == want
        store.upsert(frame)
        assert rows_of(store.read()) == want


def test_update_leaves_other_buckets_alone(spark, store, tmp_path):
    store.insert(items(spark, [(f"k{i}", 1.0, None) for i in range(100)]))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "items").rglob("*.parquet")}
    before = files()
    store.upsert(items(spark, [("k5", 2.0, None)]))
    after = files()
    kept = set(before) & set(after)
    assert kept and len({p.split("_bucket=")[1][0] for p in set(before) - kept}) == 1


def test_insert_refuses_duplicates(spark, store):
    with pytest.raises(DuplicateKeyError):
        store.insert(items(spark, [("a", 1.0, None), ("a", 2.0, None)]))
    with pytest.raises(DuplicateKeyError):
        store.insert(items(spark, [(None, 1.0, None)]))
    store.insert(items(spark, [("a", 1.0, None)]))
    with pytest.raises(DuplicateKeyError):
        store.insert(items(spark, [("a", 2.0, None)]))
    assert rows_of(store.read()) == [("a", 1.0, None)]
    store.reset()
    assert store.read().count() == 0


def test_upsert_takes_the_last_row_of_a_key(spark, store):
    rows = [("hot", float(i), str(i), i) for i in range(500)] + [("b", 1.0, None, 0)]
    frame = spark.createDataFrame(rows, "_id string, price double, extra string, id int").repartition(4)
    with pytest.raises(DuplicateKeyError):
        store.upsert(frame.drop("id"))
    store.upsert(frame, order=["id"])
    assert rows_of(store.read()) == [("b", 1.0, None), ("hot", 499.0, "499")]


def test_unknown_columns_are_refused(spark, store):
    with pytest.raises(ValueError):
        store.insert(spark.createDataFrame([("a", 1)], "_id string, other int"))


def test_duplicated_keys(spark):
    df = items(spark, [("a", 1.0, None), ("a", 1.0, None), ("b", 1.0, None)])
    assert [r["_id"] for r in duplicated_keys(df).collect()] == ["a"]


def test_write_batches(spark, tmp_path):
    target = str(tmp_path)

    def make_writer():
        import uuid

        def write(documents):
            with open(f"{target}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(d["_id"] for d in documents))

        return write

    df = items(spark, [(f"k{i}", 1.0, None) for i in range(95)]).repartition(6)
    assert write_batches(df, make_writer, batch_size=10, concurrency=3) == 95
    sent = [p.read_text().split("\n") for p in tmp_path.iterdir() if p.is_file() and not p.name.endswith(".crc")]
    assert sorted(sum(sent, [])) == sorted(f"k{i}" for i in range(95))
    assert max(map(len, sent)) == 10


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "id,name,img,asin,price,mrp,rating,ratingTotal,discount,seller,purl,note\n"
        '1,"two\nlines","a;b",,NA,10.5,nan,,3,"says ""hi""",NA,extra\n'
        '2,"",x,y,1,2,4.5,7,#N/A,s,p,\n'
    )
    df = read_catalog_csv(spark, str(path), partitions=3)
    one, two = df.orderBy("id").collect()
    assert one["name"] == "two\nlines" and one["seller"] == 'says "hi"'
    assert (one["price"], one["mrp"], one["rating"], one["ratingTotal"], one["discount"]) == (None, 10.5, None, None, 3)
    assert (one["asin"], one["purl"], one["note"]) == ("", "NA", "extra")
    assert (two["name"], two["rating"], two["ratingTotal"], two["discount"], two["note"]) == ("", 4.5, 7, None, "")
    assert df.schema["id"].dataType == T.LongType() and df.schema["price"].dataType == T.DoubleType()
    assert df.rdd.getNumPartitions() == 3
    assert read_catalog_csv(spark, str(path), limit=1).count() == 1


def test_csv_with_a_bad_number_fails(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("id,name,price\n1,a,cheap\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_catalog_csv(spark, str(path)).collect()


def raw(spark, names):
    rows = [(i, n, f"http://x; http://img/{n} ", None, float(i), None, 4.0, None, None, None, None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, RAW_CATALOG)


def test_fetch_failures_give_empty_bytes(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError
        return url.encode()

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "url string")
    got = {r["url"]: bytes(r["img"]) for r in fetch_assets(df, fetch).collect()}
    assert got == {"good": b"good", "bad": b"", None: b""}
    assert fetch_assets(df, fetch).filter(has_asset()).count() == 1


def test_stored_assets(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"123")
    assets = read_stored_assets(spark, str(tmp_path))
    url = assets.first()["url"]
    df = spark.createDataFrame([(url,), ("missing",)], "url string")
    assert {r["url"]: bytes(r["img"]) for r in join_assets(df, assets).collect()} == {url: b"123", "missing": b""}


def test_retries():
    for failures, want in ((0, "v"), (5, "v"), (6, None)):
        left = [failures]

        def call():
            if left[0]:
                left[0] -= 1
                raise TimeoutError
            return "v"

        assert with_retries(call)() == want


def test_models_see_fixed_size_batches(spark):
    def make_model():
        return lambda batch: {"size": [len(batch)] * len(batch)}

    df = spark.range(25).coalesce(1)
    sizes = [r["size"] for r in infer(df, make_model, "size int", batch_size=10).collect()]
    assert sorted(sizes) == [5] * 5 + [10] * 20


def test_online_rules(spark):
    """No description: nothing that depends on it, but the name is still embedded."""
    done = enrich_online(raw(spark, ["hat", "hat3"]), StubClient, require_complete=False)
    rows = {r["_id"]: r for r in done.collect()}
    lost = rows["hat3"]
    assert lost["description"] is None and lost["name_embedding"] == [4.0, 1.0]
    assert [lost[c] for c in ("category", "season", "color", "description_embedding")] == [None] * 4
    assert rows["hat"]["img"] == "http://x; http://img/hat "
    assert enrich_online(raw(spark, ["hat", "hat3"]), StubClient).count() == 0
    assert enrich_online(raw(spark, ["red", "red3"]), StubClient).count() == 1


def models(assets_of):
    return OfflineModels(assets_of, make_describer, make_classifier)


def test_offline_keeps_rows_without_labels(spark):
    add = lambda df: fetch_assets(df, lambda url: b"" if "none" in url else b"12345")
    done = enrich_offline(raw(spark, ["red hat", "plain", "none"]), models(add)).collect()
    rows = {r["_id"]: r for r in done}
    assert set(rows) == {"red hat", "plain"}
    assert rows["red hat"]["color"] == "Red" and rows["plain"]["color"] is None
    assert rows["plain"]["description"] == "plain in 5 bytes"
    assert len(rows["plain"]["name_embedding"]) == 1024


def test_budgets_reach_the_models(spark):
    seen = {}

    def describer(budget):
        seen["description"] = budget
        return make_describer()

    def classifier(budgets):
        seen.update(budgets)
        return make_classifier()

    add = lambda df: fetch_assets(df, lambda url: b"1")
    enrich_offline(raw(spark, ["one two three"]), OfflineModels(add, describer, classifier))
    assert seen["description"].max_total == seen["description"].max_input + 256
    assert seen["color"].max_output == 41 and set(seen) == {"description", "category", "season", "color"}


def test_token_budget_sums(spark):
    df = spark.createDataFrame([("a b", "c d e"), ("a", None)], "name string, description string")
    rows = {r["stage"]: r for r in token_budgets(df).collect()}
    assert rows["category"]["max_total"] == rows["category"]["max_input"] + 41
    assert rows["description"]["max_input"] > 1176


def test_modes(spark, tmp_path):
    add = lambda df: fetch_assets(df, lambda url: b"1")
    store = CatalogTable(spark, str(tmp_path / "catalog"), buckets=2)
    run = lambda names: enrich_offline(raw(spark, names), models(add))
    assert load(store, run(["a", "b"]), "first_run").count() == 2
    with pytest.raises(DuplicateKeyError):
        load(store, run(["c", "c"]), "first_run")
    load(store, run(["a", "b"]), "first_run")
    after = load(store, run(["b", "c", "c"]), "update")
    assert sorted((r["_id"], r["price"]) for r in after.collect()) == [("a", 0.0), ("b", 0.0), ("c", 2.0)]
    with pytest.raises(ValueError):
        load(store, run(["a"]), "other")


def test_stream_is_idempotent(spark, tmp_path):
    add = lambda df: fetch_assets(df, lambda url: b"1")
    enrich = lambda df: enrich_offline(df, models(add))
    store = CatalogTable(spark, str(tmp_path / "catalog"), buckets=2)
    source = str(tmp_path / "arrivals")
    for names in (["a", "b"], ["b", "c"]):
        raw(spark, names).write.mode("append").parquet(source)
        start_updates(spark, source, store, enrich, str(tmp_path / "check")).awaitTermination()
    first = sorted(r["_id"] for r in store.read().collect())
    start_updates(spark, source, store, enrich, str(tmp_path / "check2")).awaitTermination()
    assert first == ["a", "b", "c"] == sorted(r["_id"] for r in store.read().collect())


@pytest.mark.parametrize("folders", [(), ("category",)])
def test_search_layout(spark, tmp_path, folders):
    from test_search import make_catalog

    catalog = make_catalog(spark)
    write_search_layout(catalog, str(tmp_path / "c"), folders)
    stored = spark.read.parquet(str(tmp_path / "c")).select(*catalog.columns)
    assert rows_of(stored.drop("description_embedding")) == rows_of(catalog.drop("description_embedding"))


def test_storage_helpers(spark):
    assert rows_if_at_most(spark.range(3), 2) is None
    assert len(rows_if_at_most(spark.range(3), 3)) == 3
    assert is_small(spark.range(3), 3) and not is_small(spark.range(3), 2)
    assert is_small(spark.range(0), 3) and not is_small(spark.range(3), 3, max_bytes=10)
    assert materialise(spark.range(4).withColumn("x", F.lit("a")), "t").count() == 4

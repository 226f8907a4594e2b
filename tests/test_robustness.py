"""Odd input that must neither end a run nor change its result, and limits that must hold."""

import pytest
from pyspark.sql import functions as F
from test_search import EVERYTHING, catalog, make_catalog  # noqa: F401
from test_tables import models, raw

from registry.enrich import StubClient, make_describer
from wareseek.functions.geometry import crop_center_square
from wareseek.functions.text import DESCRIPTION_PROMPT
from wareseek.operators import batch, vector
from wareseek.operators.filters import Conditions
from wareseek.operators.inference import describe, infer
from wareseek.operators.lexical import LexicalIndex
from wareseek.operators.vector import nearest_per_query
from wareseek.plans.enrich import OfflineModels, enrich_online, load
from wareseek.plans.search import SearchRequest, ai_search, batch_ai_search, hybrid_search, legacy_search, lexical_search
from wareseek.sources.assets import fetch_assets
from wareseek.sources.csv import read_catalog_csv, write_catalog_csv
from wareseek.sources.table import CatalogTable, DuplicateKeyError, write_batches
from wareseek.streaming.updates import start_updates

rows_of = lambda df: sorted(map(str, df.collect()))


def requests(spark, ids, dims=8):
    rows = [(i, [float((k or 0) % 5), 1.0] + [0.5] * (dims - 2)) for i, k in enumerate(ids)]
    return spark.createDataFrame([(k, v) for (_, v), k in zip(rows, ids)], "query_id long, vector array<float>")


@pytest.mark.parametrize("ids", [[1, 2, 2, 3], [1, None, 3], [7] * 6])
def test_repeated_or_missing_ids_are_refused(spark, catalog, monkeypatch, ids):  # noqa: F811
    monkeypatch.setattr(vector, "MAX_QUERIES_PER_PASS", 5)
    with pytest.raises(ValueError):
        nearest_per_query(catalog, requests(spark, ids), 3)


def test_slices_change_neither_rows_nor_the_plan(spark, catalog, monkeypatch):  # noqa: F811
    queries = requests(spark, range(60))
    whole = rows_of(nearest_per_query(catalog, queries, 4))
    monkeypatch.setattr(vector, "MAX_QUERIES_PER_PASS", 7)
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    few, many = (nearest_per_query(catalog, q, 4) for q in (queries.where("query_id < 20"), queries))
    assert rows_of(many) == whole and plan(few) == plan(many)


def test_conditions_per_query(spark, catalog):  # noqa: F811
    columns = "query_id long, vector array<float>, min_price double, max_price double, min_rating double, categories array<string>, colors array<string>, seasons array<string>"
    all_labels = [["Tops", "Bottoms"], ["Red", "Blue"], ["Summer", "Winter"]]
    one = spark.createDataFrame([(1, [1.0] * 8, None, None, None, *all_labels)], columns)
    stated = spark.createDataFrame([(1, [1.0] * 8, 0.0, 1e9, 0.0, *all_labels)], columns)
    found = rows_of(nearest_per_query(catalog, one, 5))
    assert found and found == rows_of(nearest_per_query(catalog, stated.withColumn("max_price", F.lit(Conditions().max_price)), 5))
    with pytest.raises(ValueError):
        nearest_per_query(catalog, stated.drop("colors"), 5)


def test_text_searches_agree_with_a_stored_index(spark, catalog, tmp_path):  # noqa: F811
    index = LexicalIndex.of(catalog).save(str(tmp_path / "index"), buckets=8)
    request = SearchRequest("red hat", EVERYTHING, 9, threshold=0.5)
    embed = lambda text: [0.5] * 8
    for search in (
        lambda **i: lexical_search(catalog, "red hat", EVERYTHING, 9, **i),
        lambda **i: legacy_search(catalog, "long dress", EVERYTHING, 9, **i),
        lambda **i: hybrid_search(catalog, request, [0.5] * 8, **i),
        lambda **i: ai_search(catalog, SearchRequest("red hat", EVERYTHING, 9, ("lexical",)), embed, **i),
    ):
        assert rows_of(search()) == rows_of(search(index=index)) != []


def test_online_keeps_rows_without_id_and_survives_missing_names(spark):
    given = raw(spark, ["red", "hat"]).withColumn("id", F.lit(None).cast("long"))
    whole = enrich_online(raw(spark, ["red", "hat"]), StubClient).count()
    assert enrich_online(given, StubClient).count() == whole > 0
    unnamed = given.withColumn("name", F.when(F.col("name") != "hat", F.col("name")))
    rows = enrich_online(unnamed, StubClient, require_complete=False).collect()
    lost = [r for r in rows if r["name"] is None]
    assert len(rows) == 2 and len(lost) == 1 and lost[0]["description"] is lost[0]["name_embedding"] is None


def test_undecodable_pictures_are_missing_ones(spark):
    import numpy as np

    def decode(data, size):
        if data == b"bad":
            raise OSError("not a picture")
        return np.zeros((size, size + 4, 3), dtype=np.uint8)

    df = spark.createDataFrame([(1, b"ok"), (2, b"bad"), (3, None)], "id long, img binary")
    rows = {r["id"]: r["img"] for r in crop_center_square(df, decode, size=4).collect()}
    assert len(rows[1]) == 48 and rows[2] is rows[3] is None


def test_refused_first_run_keeps_the_table(spark, tmp_path):
    store = CatalogTable(spark, str(tmp_path / "catalog"), buckets=2)
    records = lambda names: spark.createDataFrame([(n, n) for n in names], "_id string, name string")
    load(store, records(["a", "b"]), "first_run")
    with pytest.raises(DuplicateKeyError):
        load(store, records(["c", "c"]), "first_run")
    assert [r["_id"] for r in store.read().orderBy("_id").collect()] == ["a", "b"]
    assert [r["_id"] for r in load(store, records(["d"]), "first_run").collect()] == ["d"]


def test_small_updates_shuffle_no_stored_rows(spark, tmp_path, monkeypatch):
    store = CatalogTable(spark, str(tmp_path / "catalog"), buckets=2)
    store.insert(spark.createDataFrame([(str(i), "n") for i in range(50)], "_id string, name string"))
    hints = []
    monkeypatch.setattr(store, "_write", lambda df, mode, rebalance=True, **_: hints.append((df, rebalance)))
    store.upsert(spark.createDataFrame([("3", "x"), ("new", "y")], "_id string, name string"))
    written, rebalance = hints[0]
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert not rebalance and "Exchange hashpartitioning" not in plan


def test_models_load_once_under_one_name(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def make(label):
        def make_model():
            with open(loads, "a") as out:
                out.write(label + "\n")
            return lambda part: {"y": [label] * len(part)}

        return make_model

    df = spark.range(20).coalesce(1)
    for name in ("first", "first", "second"):
        assert {r["y"] for r in infer(df, make(name), "y string", model_name=name).collect()} == {name}
    assert len(open(loads).read().split()) <= 3


def test_profiles_and_names_reach_the_stages(spark):
    offline = OfflineModels(lambda df: fetch_assets(df, lambda url: b"1"), make_describer, make_describer, profiles={"describe": "gpu"}, name="v1")
    assert offline.stage("describe", 3) == {"profile": "gpu", "model_name": "v1 describe 3"}
    assert offline.stage("classify", 3)["profile"] is None
    assert models(None).stage("describe", 3)["model_name"] is None


def test_sink_keeps_the_tasks_before_it(spark, tmp_path):
    def make_writer():
        return lambda documents: None

    seen = str(tmp_path / "tasks")

    def mark(batches):
        with open(seen, "a") as out:
            out.write("task\n")
        yield from batches

    df = spark.range(64).repartition(16).mapInPandas(mark, "id long")
    assert write_batches(df, make_writer, concurrency=3) == 64
    assert len(open(seen).read().split()) == 16


def test_stream_of_csv_files(spark, tmp_path):
    source, store = str(tmp_path / "arrivals"), CatalogTable(spark, str(tmp_path / "catalog"), buckets=2)
    given = raw(spark, ["a", "b", "b"])
    write_catalog_csv(given.coalesce(1), source)
    seen = []

    def enrich(df):
        seen.append(df.count())
        return df.select(F.col("name").alias("_id"), "name", "price", "id")

    start_updates(
        spark, source, store, enrich, str(tmp_path / "check"), schema=given.schema, file_format="csv"
    ).awaitTermination()
    assert seen == [2] and sorted(r["_id"] for r in store.read().collect()) == ["a", "b"]
    assert rows_of(read_catalog_csv(spark, source, given.schema)) == rows_of(given.fillna(""))


def test_table_of_requests_is_dispatched_as_single_ones(spark, catalog):  # noqa: F811
    vector_of = [0.5, 1.0, 1.0, 1.0, 0.2, 1.0, 1.0, 1.0]
    stated = [
        ("red hat", ["Lexical", "vector"], Conditions(0, 1000, 0, ["Tops"], ["Red"], ["Summer"])),
        ("red hat", None, EVERYTHING),
        ("long dress", ["lexical"], EVERYTHING),
        ("red hat", ["vector"], Conditions(10, 60, 1.0, ["Tops", "Bottoms"], ["Red"], ["Winter"])),
        ("  ", ["vector"], Conditions(10, 60, 1.0, ["Tops"], [], [])),
        (None, None, EVERYTHING),
    ]
    rows = [
        (i, text, vector_of, types, 3 + i, float(c.min_price), float(c.max_price), float(c.min_rating), c.categories, c.colors, c.seasons)
        for i, (text, types, c) in enumerate(stated)
    ]
    requests = spark.createDataFrame(
        rows,
        "query_id long, text string, vector array<float>, search_types array<string>, n int, min_price double, "
        "max_price double, min_rating double, categories array<string>, colors array<string>, seasons array<string>",
    )
    shared = SearchRequest("", Conditions(), 1, threshold=0.5)
    found = {}
    for r in batch_ai_search(catalog, requests, shared).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["image"], r["name"]))
    for i, (text, types, conditions) in enumerate(stated):
        one = SearchRequest(text, conditions, 3 + i, types or ("lexical", "vector"), threshold=0.5)
        single = ai_search(catalog, one, lambda text: vector_of).orderBy("rank").collect()
        assert found.get(i, []) == [(r["rank"], r["image"], r["name"]) for r in single] != [], i
    with pytest.raises(ValueError):
        batch_ai_search(catalog, requests.withColumn("search_types", F.array(F.lit("other"))), shared)
    assert batch_ai_search(catalog, requests.limit(0), shared).count() == 0


def test_a_model_holds_few_rows_and_leaves_the_others_as_they_are(spark):
    big = 2**53 + 1
    rows = [(i, big if i % 3 else None, bytes([i % 7]) * 5) for i in range(1_500)]
    df = spark.createDataFrame(rows, "id long, big long, picture binary").coalesce(1)

    def make_model():
        return lambda part: {"seen": [len(part)] * len(part), "none": [None if i % 2 else float("nan") for i in part["id"]]}

    done = infer(df, make_model, "seen int, none string", batch_size=100, drop=("picture",))
    assert done.columns == ["id", "big", "seen", "none"]
    assert sorted(map(tuple, done.collect())) == [(i, b, 100, None) for i, b, _ in rows]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_prompts_are_made_in_the_worker(spark):
    """The literals of a prompt, longer than most pictures, do not travel there with each row; texts are the same."""
    rows = [(i, None if i % 5 == 0 else f"näme {i}", b"x") for i in range(700)]
    df = spark.createDataFrame(rows, "id int, name string, img binary")

    def make_model():
        return lambda batch: {"description": list(batch["description_prompt"])}

    made = describe(df, make_model, batch_size=70, prompt=DESCRIPTION_PROMPT)
    plan = made._jdf.queryExecution().toString()
    assert made.columns == ["id", "name", "description"] and "<image>" not in plan
    expected = df.withColumn("expected", DESCRIPTION_PROMPT.text())
    assert made.join(expected, "id").filter(~F.col("description").eqNullSafe(F.col("expected"))).count() == 0
    numbers = df.select("id", F.col("id").alias("name"), "img")  # not strings: made by Spark, as before
    assert describe(numbers, make_model, prompt=DESCRIPTION_PROMPT).filter("id = 3").first()["description"].count(" 3.") == 1

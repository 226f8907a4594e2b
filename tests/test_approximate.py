"""Bucket search over vectors: what it finds, what it misses, and hot buckets."""

import random

import numpy as np
import pytest

from registry import search as registered
from registry.base import catalog as registered_catalog
from wareseek.operators import approximate
from wareseek.operators.approximate import Planes, VectorIndex, choose_planes
from wareseek.operators.filters import Conditions
from wareseek.operators.vector import nearest_per_query

SF_DIR = "/root/testdata/sf0.01"


def clustered(rows, dims=32, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return middle[rng.integers(0, centres, rows)] + 0.35 * rng.normal(size=(rows, dims))


def make(spark, vectors, extra=()):
    rows = [(f"k{i:05d}", f"n{i}", "img", float(i % 100), v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(
        rows + list(extra), "_id string, name string, img string, price double, description_embedding array<float>"
    )


def recall(found, exact):
    """The share of exact results that are found; one of equal score is as good."""
    least, got, want = {}, 0, 0
    for r in exact:
        least[r["query_id"]] = min(least.get(r["query_id"], 1.0), r["score"])
        want += 1
    got = sum(r["score"] >= least[r["query_id"]] for r in found)
    return got / want


def test_registered_index_recall(spark):
    """Recall at 20 of the production parameters, over every query whose id is divisible by 50."""
    rows, queries = registered_catalog(spark, SF_DIR), registered.ann_queries(spark, SF_DIR)
    index = registered.vector_index(spark, SF_DIR)
    found = index.nearest(rows, queries, 20).collect()
    exact = index.nearest(rows, queries, 20, exact=True).collect()
    assert queries.count() == 10 and len(exact) == 200
    assert recall(found, exact) >= 0.9


def test_narrow_conditions_are_searched_exactly(spark, monkeypatch):
    where = Conditions(900, 990, 1.0).lenient()
    rows, queries = registered_catalog(spark, SF_DIR), registered.ann_queries(spark, SF_DIR)
    index = registered.vector_index(spark, SF_DIR)
    exact = index.nearest(rows, queries, 20, where, exact=True).collect()
    assert sorted(index.nearest(rows, queries, 20, where).collect()) == sorted(exact)
    monkeypatch.setattr(approximate, "EXACT_ROWS", 10)
    assert 0.8 < recall(index.nearest(rows, queries, 20, where).collect(), exact) < 1


def test_chosen_planes_find_near_vectors_among_few_candidates(spark, tmp_path):
    vectors = clustered(4_000).tolist()
    odd = [("null", "n", "img", 1.0, None), ("zero", "n", "img", 1.0, [0.0] * 32), ("short", "n", "img", 1.0, [1.0]),
           ("nan", "n", "img", 1.0, [float("nan")] * 32)]
    rows = make(spark, vectors, odd).repartition(4).cache()
    index = VectorIndex.build(rows, str(tmp_path / "index"), dims=32, part_rows=200)
    indexed = {r["_id"] for r in index.entries.select("_id").distinct().collect()}
    assert indexed == {f"k{i:05d}" for i in range(4_000)}
    queries = spark.createDataFrame([(i, vectors[i]) for i in range(0, 4_000, 50)] + [(-1, [0.0] * 32), (-2, None)], "query_id int, vector array<float>")
    exact = nearest_per_query(rows, queries, 20).collect()
    assert recall(index.nearest(rows, queries, 20).collect(), exact) >= 0.9
    assert index.candidates(queries).count() < 0.35 * 80 * 4_000
    read = lambda df: sorted(map(tuple, df.select("query_id", "rank", "_id", "score").collect()))
    assert read(index.nearest(rows, queries, 20, exact=True)) == sorted((r["query_id"], r["rank"], r["_id"], r["score"]) for r in exact)


def test_large_buckets_are_split_without_loss(spark, tmp_path):
    random.seed(1)
    copies = [[1.0] * 16] * 900
    others = [[random.uniform(-1, 1) for _ in range(16)] for _ in range(300)]
    rows = make(spark, copies + others).cache()
    planes = Planes(16, 3, 6)
    whole = VectorIndex.build(rows, str(tmp_path / "whole"), planes)
    parts = VectorIndex.build(rows, str(tmp_path / "parts"), planes, part_rows=50)
    assert whole.large.count() == 0 and parts.large.count() >= 6
    most = parts.entries.groupBy("cell", "part").count().agg({"count": "max"}).first()[0]
    assert most < 120
    queries = spark.createDataFrame([(1, [1.0] * 16), (2, others[0])], "query_id long, vector array<float>")
    pairs = lambda index: sorted(map(tuple, index.candidates(queries).collect()))
    assert pairs(whole) == pairs(parts)
    best = parts.nearest(rows, queries, 5).filter("query_id = 1").orderBy("rank").collect()
    assert [(r["_id"], r["score"]) for r in best] == [(f"k{i:05d}", 1.0) for i in range(5)]


def test_many_pairs_are_met_in_blocks_and_not_listed(spark, tmp_path, monkeypatch):
    random.seed(2)
    vectors = clustered(600).tolist() + [[1.0] * 32] * 200
    odd = [("zero", "n", "img", 1.0, [0.0] * 32), ("short", "n", "img", 1.0, [1.0]), ("null", "n", "img", 1.0, None)]
    rows = make(spark, vectors, odd).repartition(4).cache()
    index = VectorIndex.build(rows, str(tmp_path / "index"), Planes(32, 4, 6), part_rows=50)
    asked = [(i, vectors[i]) for i in range(0, 800, 8)] + [(-1, [0.0] * 32), (-2, None), (-3, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    monkeypatch.setattr(approximate, "MAX_QUERIES_PER_PASS", 40)
    monkeypatch.setattr(VectorIndex, "candidates", None)
    read = lambda found: sorted((r["query_id"], r["rank"], r["_id"], r["name"], r["img"], r["score"]) for r in found.collect())
    assert not index.few_pairs(queries)
    blocks = read(index.nearest(rows, queries, 20))
    monkeypatch.undo()
    monkeypatch.setattr(approximate, "PAIRS_PER_ROW", 10_000)
    assert index.few_pairs(queries)
    assert blocks == read(index.nearest(rows, queries, 20))
    assert {r[0] for r in blocks} == set(range(0, 800, 8))


def test_repeated_query_ids_are_refused(spark, tmp_path):
    rows = make(spark, clustered(50).tolist())
    index = VectorIndex.build(rows, str(tmp_path / "index"), Planes(32, 2, 2))
    queries = spark.createDataFrame([(1, [1.0] * 32), (1, [2.0] * 32)], "query_id long, vector array<float>")
    with pytest.raises(ValueError, match="repeated"):
        index.nearest(rows, queries, 5)


def test_batch_form_is_a_join_of_buckets(spark, tmp_path):
    rows = make(spark, clustered(500).tolist())
    index = VectorIndex.build(rows, str(tmp_path / "index"), Planes(32, 8, 4))
    queries = spark.createDataFrame([(1, [1.0] * 32)], "query_id long, vector array<float>")
    plan = index.candidates(queries)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "PushedFilters: [In(cell" in plan


def test_empty_catalog_and_no_sample(spark, tmp_path):
    rows = make(spark, []).limit(0)
    index = VectorIndex.build(rows, str(tmp_path / "index"), dims=8)
    queries = spark.createDataFrame([(1, [1.0] * 8)], "query_id long, vector array<float>")
    assert index.nearest(rows, queries, 5).count() == 0
    assert choose_planes(np.eye(8)).dims == 8

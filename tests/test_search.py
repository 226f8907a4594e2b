import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareseek.functions.text import split_tokens
from wareseek.operators import batch, lexical, vector
from wareseek.operators.filters import Conditions, drop_incomplete, facet_optional, facet_required, nan_to_null, rating_at_least
from wareseek.operators.lexical import LexicalIndex, query_terms, score_names
from wareseek.operators.ranking import keep_first, keep_last, rank_score, top_n_per_query
from wareseek.operators.vector import nearest, nearest_per_query, vector_search
from wareseek.plans.search import (
    SearchRequest,
    ai_search,
    batch_hybrid_search,
    batch_lexical_search,
    browse,
    hybrid_search,
    legacy_search,
    lexical_search,
)

WORDS = ["red", "blue", "hat", "shoe", "dress", "men's", "long"]
EVERYTHING = Conditions(0, 1000, 0, ["Tops", "Bottoms"], ["Red", "Blue"], ["Summer", "Winter"])


def make_catalog(spark, rows=300, dims=8, seed=1):
    """A third of the rows are copies of one product."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        copy = i % 3 == 0
        name = "red hat" if copy else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        vec = [1.0] * dims if copy else [rng.uniform(-1, 1) for _ in range(dims)]
        out.append(
            (
                f"k{i:04d}", name, f"x; img{i} ", float(rng.randint(1, 100)),
                rng.choice([None, 1.0, 3.5, 5.0]), rng.choice(["Tops", "Bottoms"]),
                rng.choice(["Summer", "Winter", None]), rng.choice(["Red", "Blue"]),
                rng.choice([vec, vec, vec, None]) if not copy else vec,
            )
        )
    return spark.createDataFrame(
        out,
        "_id string, name string, img string, price double, rating double, category string, "
        "season string, color string, description_embedding array<float>",
    )


@pytest.fixture(scope="module")
def catalog(spark):
    return make_catalog(spark).repartition(5).cache()


def brute_bm25(rows, text):
    docs = {r["_id"]: split_tokens(r["name"]) for r in rows}
    docs = {k: d for k, d in docs.items() if d}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for key, words in docs.items():
        total, tf = 0.0, Counter(words)
        for term, repeats in Counter(split_tokens(text)).items():
            df = sum(term in d for d in docs.values())
            if tf[term]:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                total += repeats * idf * tf[term] / (tf[term] + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if total:
            scores[key] = round(total, 9)
    return scores


def as_scores(df):
    return {r["_id"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("text", ["red hat", "red red dress", "men's", "nothing known", "hat zzz"])
def test_relevance_matches_brute_force(spark, catalog, tmp_path, text):
    want = brute_bm25(catalog.collect(), text)
    assert as_scores(score_names(catalog, text)) == pytest.approx(want)
    assert as_scores(LexicalIndex.of(catalog).search(text)) == pytest.approx(want)


def test_stored_index_gives_the_same(spark, catalog, tmp_path):
    index = LexicalIndex.of(catalog).save(str(tmp_path / "index"))
    want = brute_bm25(catalog.collect(), "blue shoe")
    assert as_scores(index.search("blue shoe")) == pytest.approx(want)
    queries = spark.createDataFrame([("a", "blue shoe"), ("b", "red")], "query_id string, text string")
    run = lambda i: sorted(map(tuple, batch_lexical_search(catalog, queries, EVERYTHING, 7, i).select("query_id", "rank", "_id", "score").collect()))
    assert run(index) == run(None) and len(run(None)) == 14


def test_large_term_tables_take_the_salted_join(spark, catalog, monkeypatch):
    queries = spark.createDataFrame([("a", "blue shoe"), ("b", "red")], "query_id string, text string")
    index = LexicalIndex.of(catalog)
    scores = lambda: sorted(map(tuple, index.score(query_terms(queries)).collect()))
    small = scores()
    monkeypatch.setattr(lexical, "MAX_BROADCAST_TERMS", 1)
    assert scores() == small
    want = brute_bm25(catalog.collect(), "red")
    assert {k: s for q, k, s in small if q == "b"} == pytest.approx(want)


def brute_nearest(rows, query, n, keep=lambda r: True):
    q = np.array(query) / np.linalg.norm(query)
    scored = []
    for r in rows:
        v = r["description_embedding"]
        if v is not None and keep(r):
            v = np.array(v, dtype=np.float64)
            scored.append((-round((1 + v @ q / np.linalg.norm(v)) / 2, 9), r["_id"]))
    return [key for _, key in sorted(scored)[:n]]


def test_nearest_matches_brute_force(catalog):
    query = [0.3, -1, 0.2, 0.9, 0, 0.1, -0.4, 0.5]
    got = [r["_id"] for r in nearest(catalog, query, 15).orderBy(F.desc("score"), "_id").collect()]
    assert got == brute_nearest(catalog.collect(), query, 15)


def test_fewer_rows_than_n_gives_no_null_scores(catalog):
    few = catalog.filter("_id < 'k0010'")
    got = nearest(few, [1.0] * 8, 50).collect()
    assert len(got) == len(brute_nearest(few.collect(), [1.0] * 8, 50))
    assert all(r["score"] is not None for r in got)


def query_rows(spark, count=9, dims=8):
    rng = random.Random(5)
    rows = [(i, "red hat", [1.0] * dims) if i == 0 else (i, rng.choice(WORDS), [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(count)]
    return spark.createDataFrame(rows, "query_id long, text string, vector array<float>")


@pytest.mark.parametrize("per_pass", [2_000, 2])
def test_query_table_matches_single_queries(spark, catalog, monkeypatch, per_pass):
    """Ties of a hundred copies included, in one pass and in many."""
    monkeypatch.setattr(vector, "MAX_QUERIES_PER_PASS", per_pass)
    queries = query_rows(spark)
    got = {}
    for r in nearest_per_query(catalog, queries, 12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["_id"])
    rows = catalog.collect()
    assert got == {q["query_id"]: brute_nearest(rows, q["vector"], 12) for q in queries.collect()}


def test_small_score_blocks_change_nothing(spark, catalog, monkeypatch):
    queries = query_rows(spark)
    read = lambda: sorted(map(tuple, nearest_per_query(catalog, queries, 5).collect()))
    whole = read()
    monkeypatch.setattr(batch, "SCORE_BLOCK_ROWS", 7)
    assert read() == whole


@pytest.mark.parametrize("per_pass", [1_000, 2])
def test_text_queries_match_brute_force(spark, catalog, monkeypatch, per_pass):
    monkeypatch.setattr(lexical, "MAX_QUERIES_PER_PASS", per_pass)
    texts = ["red hat", "blue shoe", "red red dress", "zzz", "long", "men's hat shoe"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    rows = catalog.collect()
    want = {}
    for i, text in enumerate(texts):
        ordered = sorted((-s, k) for k, s in brute_bm25(rows, text).items())[:12]
        for place, (score, key) in enumerate(ordered):
            want[i, place] = (key, -score)
    everything = Conditions(0, 1000, 0)
    kept = {r["_id"] for r in catalog.filter(everything.lenient()).collect()}
    got = {}
    for r in lexical.best_matches(catalog, queries, LexicalIndex.of(catalog), 12).collect():
        got[r["query_id"], r["rank"]] = (r["_id"], r["score"])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [got[k][1] for k in sorted(got)] == pytest.approx([want[k][1] for k in sorted(want)])
    filtered = batch_lexical_search(catalog, queries, everything, 12).collect()
    assert filtered and {r["_id"] for r in filtered} <= kept


def test_each_request_has_its_own_conditions(spark, catalog):
    """A table of differing requests gives what single searches give."""
    query = [0.5, 1.0, 1.0, 1.0, 0.2, 1.0, 1.0, 1.0]
    stated = [
        Conditions(0, 1000, 0, ["Tops", "Bottoms"], ["Red", "Blue"], ["Summer", "Winter"]),
        Conditions(20, 60, 1.0, ["Tops"], ["Red"], ["Summer", "Winter"]),
        Conditions(0, 1000, 3.5, ["Tops", "Bottoms"], [], ["Winter"]),
        Conditions(0, 1000, 0, ["Dresses"], ["Blue"], []),
        Conditions(0, 1000, 0, [], [], []),
    ]
    rows = [
        (i, "red hat", query, 3 + i, float(c.min_price), float(c.max_price), float(c.min_rating),
         list(c.categories), list(c.colors), list(c.seasons))
        for i, c in enumerate(stated)
    ]
    requests = spark.createDataFrame(
        rows,
        "query_id long, text string, vector array<float>, n int, min_price double, max_price double, "
        "min_rating double, categories array<string>, colors array<string>, seasons array<string>",
    )
    shared = SearchRequest("", Conditions(), 1, threshold=0.5)
    got = {}
    for r in batch_hybrid_search(catalog, requests, shared).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["name"], r["img"], r["score"]))
    for i, conditions in enumerate(stated):
        single = hybrid_search(catalog, SearchRequest("red hat", conditions, 3 + i, threshold=0.5), query)
        assert got.get(i, []) == [(r["name"], r["img"], r["score"]) for r in single.orderBy("rank").collect()], i


def test_query_without_direction_has_no_hits(spark, catalog):
    queries = spark.createDataFrame([(1, [0.0] * 8), (2, None)], "query_id long, vector array<float>")
    assert nearest_per_query(catalog, queries, 3).count() == 0


def test_batch_of_one_equals_the_single_search(spark, catalog):
    request = SearchRequest("red hat", EVERYTHING, 8, threshold=0.5)
    vector_of = [0.5, 1.0, 1.0, 1.0, 0.2, 1.0, 1.0, 1.0]
    single = hybrid_search(catalog, request, vector_of)
    queries = spark.createDataFrame([(7, "red hat", vector_of)], "query_id long, text string, vector array<float>")
    batch = batch_hybrid_search(catalog, queries, request)
    read = lambda df: sorted(map(tuple, df.select("rank", "name", "img", "vs_score", "fts_score", "score").collect()))
    assert read(batch) == read(single) and read(single)


def test_fused_score_is_the_sum(catalog):
    rows = hybrid_search(catalog, SearchRequest("red hat", EVERYTHING, 20, threshold=0.0), [1.0] * 8).collect()
    assert rows and all(r["score"] == pytest.approx(r["vs_score"] + r["fts_score"]) for r in rows)
    assert len({r["name"] for r in rows}) == len(rows)


def test_threshold_comes_after_the_cut(catalog):
    full = vector_search(catalog, [1.0] * 8, 150, threshold=0.0).collect()
    cut = vector_search(catalog, [1.0] * 8, 150, threshold=0.92).collect()
    assert len(cut) == sum(r["score"] >= 0.92 for r in full) < len(full)


def test_rating_floor(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (4.0,), (3.9,)], "rating double")
    assert [r[0] for r in df.filter(rating_at_least(4.0)).collect()] == [4.0]
    cleaned = [r[0] for r in nan_to_null(df).collect()]
    assert cleaned.count(None) == 2


def test_facets(catalog):
    assert catalog.filter(facet_required("season", [])).count() == 0
    assert catalog.filter(facet_required("season", None)).count() == 0
    assert catalog.filter(facet_optional("season", [])).count() == catalog.count()
    both = catalog.filter(facet_optional("season", ["Summer", "Winter"])).count()
    assert both == catalog.filter("season IS NOT NULL").count()


def test_more_conditions_never_add_rows(catalog):
    wide = browse(catalog, Conditions(0, 1000, 0), 1000)
    narrow = browse(catalog, Conditions(0, 1000, 0, colors=["Red"], seasons=["Summer"]), 1000)
    assert narrow.join(wide, "_id", "left_anti").count() == 0


def test_drop_incomplete(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (1, None)], "x int, y string")
    assert [tuple(r) for r in drop_incomplete(df).collect()] == [(1, "a")]


def test_dispatch(spark, catalog):
    asked = []
    embed = lambda text: asked.append(text) or [1.0] * 8
    run = lambda request: [tuple(r) for r in ai_search(catalog, request, embed).orderBy("rank").collect()]
    blank = run(SearchRequest(" \t", EVERYTHING, 5, []))
    assert len(blank) == 5 and not asked
    assert run(SearchRequest(None, EVERYTHING, 5)) == blank
    lexical_hits = run(SearchRequest("red hat", EVERYTHING, 5, ["LEXICAL"]))
    assert not asked and lexical_hits[0][2] == "red hat" and lexical_hits[0][1].startswith("img")
    assert len(run(SearchRequest("red hat", EVERYTHING, 5, ["vector"]))) == 5
    assert len(run(SearchRequest("red hat", EVERYTHING, 5, ["Vector", "Lexical"]))) >= 1
    assert asked == ["red hat"] * 2
    with pytest.raises(ValueError):
        run(SearchRequest("red hat", EVERYTHING, 5, []))
    with pytest.raises(ValueError):
        SearchRequest(embedding_column="price")
    with pytest.raises(ValueError):
        SearchRequest(n=0)


def test_vector_search_without_facets_finds_nothing(catalog):
    request = SearchRequest("red hat", Conditions(0, 1000, 0), 5, ["vector"])
    assert ai_search(catalog, request, lambda _: [1.0] * 8).count() == 0


def test_legacy_ignores_facets(catalog):
    strict = Conditions(0, 1000, 0, [], ["Green"], [])
    assert legacy_search(catalog, "red hat", strict, 5).count() == 5
    assert legacy_search(catalog, "", strict, 5).count() == 5


def test_unknown_words_find_nothing(catalog):
    assert lexical_search(catalog, "zzz", EVERYTHING, 5).count() == 0
    assert lexical_search(catalog, "!!!", EVERYTHING, 5).count() == 0


def test_top_n_per_query_with_a_hot_query(spark):
    rows = [("hot", i, float(i % 50)) for i in range(3000)] + [("cold", i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "query_id string, _id int, score double").repartition(6)
    got = top_n_per_query(df, 4).orderBy("query_id", "rank").collect()
    hot = sorted((-s, i) for q, i, s in rows if q == "hot")[:4]
    assert [(r["query_id"], r["_id"], r["rank"]) for r in got] == [
        ("cold", 2, 0), ("cold", 1, 1), ("cold", 0, 2), *[("hot", i, k) for k, (_, i) in enumerate(hot)]
    ]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(map(tuple, keep_first(df, ["k"], ["o"]).collect())) == [("a", 1, None), ("b", 5, "z")]
    assert sorted(map(tuple, keep_last(df, ["k"], ["o"]).collect())) == [("a", 2, "x"), ("b", 5, "z")]


def test_rank_score(spark):
    df = spark.createDataFrame([(0,), (3,)], "rank long")
    assert [r[0] for r in df.select(rank_score(1)).collect()] == [0.5, 0.2]
    assert [r[0] for r in df.select(rank_score(10)).collect()] == [1 / 11, 1 / 14]

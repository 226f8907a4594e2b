"""The physical plans that the design relies on."""

import re

import pytest
from pyspark.sql import functions as F

from wareseek.operators.filters import Conditions
from wareseek.operators.lexical import LexicalIndex, build_postings, score_names
from wareseek.operators.ranking import top_n_per_query
from wareseek.operators.vector import nearest, nearest_per_query
from wareseek.plans.search import SearchRequest, batch_hybrid_search, browse, hybrid_search

from test_search import EVERYTHING, make_catalog, query_rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "catalog")
    make_catalog(spark).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_reach_the_scan(stored):
    text = plan(browse(stored, Conditions(5, 50, 2.0, ["Tops"], [], []), 5))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(price,5.0)" in pushed and "GreaterThanOrEqual(rating,2.0)" in pushed
    assert "category" in pushed
    assert "TakeOrderedAndProject" in text and "description_embedding" not in text


def test_one_query_needs_no_shuffle(stored):
    text = plan(nearest(stored, [1.0] * 8, 5, where=EVERYTHING.strict()))
    assert text.count("ArrowEvalPython") == 1 and "TakeOrderedAndProject" in text and "Exchange" not in text
    text = plan(score_names(stored, "red hat"))
    assert "Exchange" not in text.split("Subquery")[0] and "Join" not in text


def test_postings_need_no_shuffle(stored):
    assert "Exchange" not in plan(build_postings(stored))


def test_no_cross_joins(spark, stored):
    request = SearchRequest("red hat", EVERYTHING, 5)
    for df in (
        hybrid_search(stored, request, [1.0] * 8),
        batch_hybrid_search(stored, query_rows(spark), request),
    ):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_top_n_is_cut_before_each_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("_id"), F.rand(1).alias("score"))
    assert plan(top_n_per_query(df, 5)).count("WindowGroupLimit") == 4


def test_stored_index_reads_only_the_terms(stored, tmp_path):
    text = plan(LexicalIndex.of(stored).save(str(tmp_path / "i")).search("red hat"))
    assert "In(term, [hat,red])" in text.replace("[red,hat]", "[hat,red]")
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", text)


def test_catalog_is_scored_where_it_lies(spark, stored):
    text = plan(nearest_per_query(stored, query_rows(spark), 5))
    below = text[text.index("MapInArrow") :]
    assert "Exchange" not in below and "_split" not in below

import random

import cases

import corpus_pipeline as c
from test_jaccard_join import brute_force
from test_secret_scan import base_spans, entropy_spans, redacted


def test_stages_take_effect(spark):
    docs = cases.documents(spark)
    names = [n for n, _ in c.STAGES]
    assert len(names) == 5
    toxic, near, secrets, mixed, pieces = (f for _, f in c.STAGES)
    kept = toxic(spark, docs, cases.SF_DIR)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{cases.SF_DIR}/labels.parquet").collect()}
    assert all(k in texts for k, y in labels.items() if y == 0)
    unique = near(spark, kept, cases.SF_DIR)
    want = {k for k, _, first in brute_force(sorted(texts.items())) if k == first}
    assert {r["doc_id"] for r in unique.collect()} == want
    clean = {r["doc_id"]: r for r in secrets(spark, unique, cases.SF_DIR).collect()}
    for key in want:
        text = texts[key] or ""
        spans = base_spans(text) + entropy_spans(text)
        assert clean[key]["text"] == redacted(text, spans)
        assert not spans or clean[key]["n_chars"] == len(clean[key]["text"])
    drawn = mixed(spark, unique, cases.SF_DIR)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == want
    assert {r["doc_id"] for r in pieces(spark, unique, cases.SF_DIR).collect()} == want


def test_run(spark):
    assert c.run(spark, cases.SF_DIR).count() > 0


def test_odd_rows(spark):
    rows = [(k, t, None if k == 5 else "en", None if k == 6 else "src", None) for k, t in cases.TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES:
        docs = stage(spark, docs, cases.SF_DIR)
    assert {r["doc_id"] for r in docs.collect()} >= {1, 2, 3, 4, 7, None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES:
        empty = stage(spark, empty, cases.SF_DIR)
    assert empty.count() == 0


def test_only_copies_are_dropped(spark):
    random.seed(6)
    a, b, c_, d, e, f = ([f"{name}{random.randrange(10**6)}" for _ in range(80)] for name in "abcdef")
    near = lambda words: " ".join([*words[:-1], "changed"])
    a, b, c_, d, e, f = [" ".join(w) for w in (a, b, c_, d, e, f)]
    rows = [(None, c_), (None, d), (None, c_), (None, None), (1, a), (3, None), (3, ""), (3, None)]
    rows += [(2, b), (2, near(a.split())), (2, b)]  # one text of the id is a copy, the other is not
    rows += [(5, e), (5, f), (5, near(e.split()))]  # of two near copies under one id one stays
    schema = "doc_id long, text string"
    kept = [tuple(r) for r in c.near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()]
    of = lambda key: sorted((t for k, t in kept if k == key), key=str)
    assert of(None) == sorted([c_, d, c_, None], key=str)
    assert of(1) == [a] and of(2) == [b] and of(3) == ["", None]
    assert len(of(5)) == 2 and f in of(5)
    # What stays of other rows does not depend on whether some id repeats.
    once = [r for r in rows if r[0] in (None, 1)]
    alone = [tuple(r) for r in c.near_duplicates(spark, spark.createDataFrame(once, schema), "").collect()]
    assert sorted(alone, key=str) == sorted((r for r in kept if r[0] in (None, 1)), key=str)

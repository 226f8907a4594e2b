import compare
import cases
from pyspark.sql import functions as F

from wareseek.llm import quality_rules as q
from wareseek.llm.queries import ORACLES, RUNS


def test_query_matches_sql(spark):
    assert compare.difference(spark, RUNS["op8_quality_rules"], ORACLES["op8_quality_rules"], cases.SF_DIR) is None


def test_edge_rows(spark):
    docs = cases.edge_docs(spark).withColumn("n_words", F.lit("clash"))
    rows = q.ledger(q.measure(docs)).collect()
    assert len(rows) == len(cases.TEXTS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_words"] == 0 and by_id[2]["failed"] & 1
    assert by_id[8]["n_repeat_words"] == by_id[8]["n_words"] == 3000
    assert q.measure(docs.limit(0)).count() == 0


def test_ablations_match_masks(spark):
    ledger = q.ledger(q.measure(cases.documents(spark).select("doc_id", "text")))
    masks = [r["failed"] for r in ledger.collect()]
    names = q.POLICIES["v2"]
    chosen = q.mask(names)
    for r in q.ablations(ledger, names).collect():
        bit = q.mask([r["rule"]])
        assert r["n_failed"] == sum(1 for m in masks if m & bit)
        assert r["n_only"] == sum(1 for m in masks if m & chosen == bit)


def test_clean_documents_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{cases.SF_DIR}/labels.parquet").collect()}
    rows = [r for r in RUNS["op8_quality_rules"](spark, cases.SF_DIR).collect() if not r["base_failed"]]
    clean = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert clean and all(clean) and sum(junk) <= len(junk) / 2


def test_ablations_of_whole_table(spark):
    assert compare.difference(spark, RUNS["rule_ablations"], ORACLES["rule_ablations"], cases.SF_DIR) is None
    assert {r["rule"] for r in RUNS["rule_ablations"](spark, cases.SF_DIR).collect()} == set(q.POLICIES["v2"])

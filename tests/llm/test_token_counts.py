import random

import cases
import pytest

from wareseek.llm.queries import RUNS, tokenizer_file
from wareseek.llm.token_counts import PrefixTable, count_tokens, prefix_counts


@pytest.fixture(scope="module")
def encoder():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())


def test_query_counts_as_the_library(spark, encoder):
    found = {r["doc_id"]: r for r in RUNS["op1_token_counts"](spark, cases.SF_DIR).collect()}
    rows = cases.rows_of(spark)
    assert len(found) == len(rows)
    for key, text in rows:
        n = len(encoder.encode(text))
        assert (found[key]["n_bytes"], found[key]["n_tokens"]) == (len(text.encode()), n)
        assert found[key]["over_limit"] == (n > 4096)


def test_every_prefix(spark, encoder):
    random.seed(5)
    table = PrefixTable(encoder)
    letters = list(" \n▁abthe.1=-_/{}()é日\t😀")
    texts = ["".join(random.choices(letters, k=random.randint(1, 25))) for _ in range(300)]
    texts += [" " * n + "a" for n in range(40)] + ["</s>[INST] <s> x", "aaaa" * 30, "});\r\n" * 4]
    texts += [t[:120] for _, t in cases.rows_of(spark)[:40]]
    for text in texts:
        assert prefix_counts(text, table).tolist() == [len(encoder.encode(text[: i + 1])) for i in range(len(text))]


def test_edge_rows(spark, encoder):
    docs = cases.edge_docs(spark).selectExpr("*", "'kept' AS extra")
    with pytest.raises(ValueError):
        count_tokens(docs.selectExpr("*", "1 AS n_tokens"), tokenizer_file())
    rows = count_tokens(docs, tokenizer_file(), budget=7).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, cases.TEXTS))
    for r in rows:
        text = r["text"] or ""
        assert r["extra"] == "kept" and len(r["prefix_tokens"]) == len(text)
        assert r["n_tokens"] == len(encoder.encode(text))
        fits = [i for i in range(len(text) + 1) if i == 0 or r["prefix_tokens"][i - 1] <= 7]
        assert r["fits_chars"] == max(fits)
    assert count_tokens(docs.limit(0), tokenizer_file()).count() == 0

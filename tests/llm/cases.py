"""Small tables that the tests of this folder share."""

from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.001")
WORD = r"[^\x20\x09-\x0D]+"

#: Nulls, empty and very long texts, repeated rows, odd spaces, strange characters.
TEXTS = [
    (1, "plain words in a short line"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "lone"),
    (6, "tabs\tand\r\nlines \x0b here  twice  twice"),
    (7, "日本語 😀 naïve é ﬁ \x00 end"),
    (8, "spam " * 3000),
    (9, "x" * 20000),
    (10, " ".join(f"w{i % 977}" for i in range(6000))),
    (10, " ".join(f"w{i % 977}" for i in range(6000))),
    (None, "no id but text"),
]
SCHEMA = "doc_id long, text string"


def edge_docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def rows_of(spark):
    """(doc_id, text) of the small data set, ordered."""
    return sorted((r["doc_id"], r["text"] or "") for r in documents(spark).select("doc_id", "text").collect())

import math
import random
import re
from collections import Counter

import cases
import numpy as np
import pyarrow as pa

from wareseek.llm import lexical_topk as k

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute_force(docs, items, top=10):
    counted = [(key, Counter(terms_of(t))) for key, t in docs]
    counted = [(key, c) for key, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    by_item = {}
    for item, text in items:
        by_item.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in by_item.items():
        scored = []
        for key, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            weight = lambda w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
            score = sum(weight(w) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_edge_rows_blocks_and_clashing_names(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(300)] + ["Éa", "日本", "UPPER", "12", "x-y"]
    rows = list(cases.TEXTS)
    rows += [(100 + i, " ".join(random.choices(words, k=random.randint(1, 80)))) for i in range(150)]
    rows += [(300 + i, "same words in every copy w1 w2") for i in range(30)] + [(None, "w1 w1 w2"), (None, "w1 w1 w2")]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 30)))) for i in range(25)]
    items += [(1, "again W7"), (50, None), (51, ""), (52, "nowhere"), (53, "same copy"), (None, "w2 w3"), (54, "w1 " * 500)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("*", "1 AS item", "2 AS rank", "3 AS n")
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 AS doc_id", "5 AS score")
    want = brute_force(rows, items)
    assert found(k.rank_documents(docs, table)) == want
    assert found(k.rank_documents(docs, table, block_pairs=100, head_rows=20)) == want
    assert k.rank_documents(docs.limit(0), table).count() == 0
    assert k.rank_documents(docs, table.limit(0)).count() == 0
    assert k.rank_documents(spark.createDataFrame([(1, None), (2, "")], cases.SCHEMA), table).count() == 0


def test_bounds_keep_whatever_reaches_the_least_score():
    random.seed(2)
    n_terms, dropped = 120, 0
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 9000, n_terms)
    rows = []
    for i in range(400):
        ids = np.sort(rng.choice(n_terms, rng.integers(1, 40), replace=False)).astype(np.int32)
        impacts = rng.integers(1, 900_000, len(ids)).astype(np.int32)
        rows.append((i, math.sqrt(float((impacts.astype(float) ** 2).sum())), ids.tobytes(), impacts.tobytes()))
    columns = list(zip(*rows))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
        ["doc_id", "norm", "ids", "numbers"],
    )
    bucket = k.Bucket(batch, n_terms)
    items = k.Items([random.sample(range(n_terms), random.randint(1, 30)) for _ in range(60)], weights)
    for q in range(len(items)):
        dense = np.zeros(n_terms, dtype=np.int64)
        dense[items.terms[q]] = items.weights[q]
        scores = bucket.scores(np.arange(len(rows)), dense)
        least = int(np.sort(scores)[-10])
        kept = bucket.survivors(items.terms[q], items.weights[q], items.focus[q], items.rest[q], least)
        assert set(np.flatnonzero(scores >= least)) <= set(kept)
        assert max(scores) <= items.norms[q] * bucket.norms.max() * k._SLACK
        dropped += len(rows) - len(kept)
    assert dropped > 60 * len(rows) // 2

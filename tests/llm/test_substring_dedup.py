import hashlib
import random
import re

import cases
from hypothesis import given, settings, strategies as st

from wareseek.llm import substring_dedup as d
from wareseek.llm.queries import RUNS


def brute_force(rows, window):
    """(key, words, removed, kept) of each row by its definition."""
    words = [(k, re.findall(cases.WORD, t or "")) for k, t in rows]
    first = {}
    for k, w in sorted(words, key=lambda x: (x[0] is None, x[0] or 0)):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            owner = first[tuple(w[i : i + window])]
            if owner is not None and (k is None or owner < k):
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def test_query(spark):
    rows = RUNS["op6_substring_dedup"](spark, cases.SF_DIR).collect()
    want = [(k, n, r, hashlib.sha256(t.encode()).hexdigest()) for k, n, r, t in brute_force(cases.rows_of(spark), 50)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert any(r["n_removed"] for r in rows)


def test_shared_passages_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_PASSAGES", 3)
    random.seed(3)
    base = [f"w{random.randint(0, 60)}" for _ in range(120)]
    rows = list(cases.TEXTS) + [(None, " ".join(base[:30]))]
    for key in range(100, 140):
        at = random.randint(0, 60)
        own = [f"u{key}x{i}" for i in range(random.randint(0, 12))]
        part = base[at : at + random.randint(5, 60)]
        if random.random() < 0.4 and part:
            part[random.randrange(len(part))] = "edit"
        rows.append((key, " ".join(own + part + own[::-1])))
    docs = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("*", "1 AS start")
    found = d.remove_repeats(docs, window=12, gram=4).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(rows, 12)
    assert d.remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_matching_statistics(references, text):
    automaton = d.Automaton()
    for r in references:
        automaton.add(r)
    held = {tuple(r[i:j]) for r in references for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    want = [max([k for k in range(1, e + 1) if tuple(text[e - k : e]) in held], default=0) for e in range(1, len(text) + 1)]
    assert automaton.matches(text) == want

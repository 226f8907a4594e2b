import hashlib
import re

import cases
import xxhash
from pyspark.sql import functions as F

from wareseek.llm import fingerprints as f
from wareseek.llm.queries import RUNS

signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
unsigned = lambda x: x & ((1 << 64) - 1)


def chained(values):
    seed = 42
    for x in values:
        seed = xxhash.xxh64_intdigest(unsigned(x).to_bytes(8, "little"), seed=unsigned(seed))
    return signed(seed)


def sketch(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(cases.WORD, text)]
    if len(h) >= 5:
        found = {chained(h[i : i + 5]) for i in range(len(h) - 4)}
    elif h:
        whole = 42
        for x in h:
            whole = chained([whole, x])
        found = {whole}
    else:
        return []
    low = sorted(x for x in found if x < -(1 << 63) + (1 << 62))
    return low or [min(found)]


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def written(hashes):
    return "".join(f"{unsigned(h):016x}" for h in hashes)


def test_query(spark):
    rows = cases.rows_of(spark)[::-1]
    found = {r["doc_id"]: r for r in RUNS["op10_fingerprints"](spark, cases.SF_DIR).collect()}
    assert len(found) == len(rows)
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = found[key]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written(sketch(text)), written(sketch(edited)))
        assert abs(r["near_edited"] - alike(sketch(text), sketch(edited))) < 1e-12
        assert abs(r["near_next"] - alike(sketch(text), sketch(following))) < 1e-12


def test_neighbours_with_ties_nulls_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(f, "_QUANTILES", 4)
    monkeypatch.setattr(f, "_ROWS_IN_RANGE", 1)
    rows = [(k, f"t{k}") for k in (5, -3, 900, 901, 902, 10**12, 7, 8, 9)] + [(5, "other"), (5, "t5"), (None, "n"), (None, None)]
    for part in (rows, rows[:1], rows[:2], [(None, "n"), (None, "m")]):
        docs = spark.createDataFrame(part, cases.SCHEMA)
        order = sorted(part, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
        want = [(*a, b[1]) for a, b in zip(order, order[1:] + order[:1])]
        found = [(r["doc_id"], r["text"], r["next_text"]) for r in f.with_next(docs, ["text"]).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
    assert f.with_next(docs.limit(0), ["text"]).count() == 0


def test_sketches_of_edge_rows_merge_and_contain(spark):
    made = f.fingerprint(cases.edge_docs(spark)).collect()
    for r in made:
        assert r["sketch"] == sketch(r["text"] or "")
    a, b = " ".join(f"a{i}" for i in range(4000)), " ".join(f"b{i}" for i in range(300))
    pair = spark.createDataFrame([(a, b, f"{b} {a}")], "a string, b string, both string")
    s = {n: f.sketch(F.col(n)) for n in ("a", "b", "both")}
    r = pair.select(
        f.merged(s["a"], s["b"]).alias("merged"), s["both"].alias("both"),
        f.containment(s["b"], s["both"]).alias("inside"), f.containment(s["both"], s["b"]).alias("outside"),
    ).first()
    assert set(r["merged"]) <= set(r["both"]) and len(r["both"]) - len(r["merged"]) <= 4
    assert r["inside"] == 1.0 and r["outside"] < 0.15

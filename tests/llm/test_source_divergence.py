import random
import re
from collections import Counter, defaultdict

import cases

from wareseek.llm import source_divergence as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, min_docs=10, top=10):
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for l, s, t in rows]
    out = []
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {l for l, _, _ in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for l, s, words in docs:
            if l == lang:
                df.update(set(words))
                counts[s].update(words)
        kept = [w for w in df if df[w] >= min_docs]
        v = len(kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * v) for w in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in p:
            pairs = sorted((-sum(apart(p[s][w], p[o][w]) for w in kept), o.encode()) for o in p if o != s)
            terms = sorted((-apart(p[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def rows_with_copies():
    random.seed(6)
    words = [f"{a}{b}" for a in "abcdeé" for b in "xyzXßñ"]
    rows = [(random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "S3", None, "é"]),
             " ".join(random.choices(words, k=random.randint(0, 60)))) for _ in range(250)]
    rows += [("en", "hot" if i % 3 else "s1", "the same ax text ay ay 12") for i in range(200)]
    rows += [("en", "s2", None), ("xx", "only", "few words"), ("yy", "one", "a b"), ("yy", "two", None), ("de", "none", "")]
    return rows + [("fr", "s1", "mot " * 20000 + "x" * 50000)] + [("fr", "s2", "mot")] * 12


def test_edge_rows_copies_and_clashing_names(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    docs = docs.selectExpr("*", "1 AS term", "2 AS digest", "3 AS n", "4 AS item", "5 AS value").repartition(5)
    want = brute_force(rows)
    assert sorted(map(tuple, d.audit(docs).collect())) == want
    # Without a broadcast of the sources.
    assert sorted(map(tuple, d.audit(docs, max_groups=1).collect())) == want
    assert d.audit(docs.limit(0)).count() == 0


def test_tasks_that_forget_and_pass_on_in_parts(monkeypatch):
    """Small limits on what a task remembers change nothing in the sums."""
    import pyarrow as pa
    import numpy as np

    rows = [(l or "", s or "", t or "") for l, s, t in rows_with_copies() if (l or "") != "fr"]
    sums = []
    for remembered, counted in ((10**6, 10**6), (5, 7)):
        monkeypatch.setattr(d, "_REMEMBERED", remembered)
        monkeypatch.setattr(d, "_COUNTED", counted)
        monkeypatch.setattr(d, "_ROWS", 3)
        columns = [pa.array(c, pa.string()) for c in zip(*rows)]
        parts = list(d._collapsed(iter([pa.RecordBatch.from_arrays(columns, ["lang", "source", "text"])])))
        table = pa.Table.from_batches(parts)
        keys = list(zip(*(table.column(c).to_pylist() for c in ("lang", "digest", "text"))))
        order = sorted(range(len(keys)), key=lambda i: (keys[i][0], keys[i][1], keys[i][2] is None))
        batches = table.take(pa.array(np.array(order))).combine_chunks().to_batches()
        total = Counter()
        for batch in d._counted(iter(batches)):
            for lang, source, term, n, documents in zip(*(batch.column(c).to_pylist() for c in range(5))):
                total[lang, source, term] += n
                total[lang, None, term] += documents
        sums.append(total)
    assert sums[0] == sums[1] and sums[0]["en", "hot", "same"] == 133 and sums[0]["en", None, "same"] == 200

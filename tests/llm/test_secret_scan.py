import collections
import hashlib
import itertools
import math
import random
import re

import cases
from pyspark.sql import functions as F

from wareseek.llm import secret_scan as s
from wareseek.llm.queries import RUNS

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def entropy_spans(text):
    found = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        if not re.search("[0-9]", run) or any(re.search(p, run) for p in s.ALLOW):
            continue
        spans = []
        for i in range(19, len(run)):
            w = run[i - 19 : i + 1]
            bits = math.log2(20) - sum(c * math.log2(c) for c in collections.Counter(w).values()) / 20
            if re.fullmatch("[0-9a-fA-F]+", w):
                high = bits >= 3.0 - 1e-6 and len(re.findall("[0-9]", w)) >= 3
            else:
                high = bits >= 3.75 - 1e-6 and all(re.search(p, w) for p in ("[0-9]", "[a-z]", "[A-Z]"))
            if high:
                start, end = m.start() + i - 19, m.start() + i + 1
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
        found += [(a, 3, b) for a, b in spans]
    return found


def listed(spans):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text, spans):
    out, end = [], 0
    groups = []
    for a, _, b in sorted(spans):
        if groups and groups[-1][1] > a:
            groups[-1][1] = max(groups[-1][1], b)
        else:
            groups.append([a, b])
    for a, b in groups:
        out += [text[end:a], "[secret]"]
        end = b
    return "".join(out) + text[end:]


ODD = [
    "password=secret: abcdefghijklmno", "é😀 token = 'ABCDEFGHIJKLmnop=='", "AKIA" + "B" * 13 + " AKIA" + "C" * 14,
    "token==abcdefghijklmnop", "x" * 50000 + "1", " ".join(f"{i:016x}" for i in range(300)), "Zq8Xw2Kp9Rt4Lm7Nv3Bs6Df1Gh5Jk0",
    "toſen secret=\n", "sha256-Zq8Xw2Kp9Rt4Lm7Nv3Bs6Df1Gh5Jk0", "example/Zq8Xw2Kp9Rt4Lm7Nv3Bs6Df1",
    "123e4567-e89b-12d3-a456-426614174000", "Zq8Xw2Kp9Rt4Lm7Nv3Bs" + "a" * 60 + "Zq8Xw2Kp9Rt4Lm7Nv3Bs6",
]


def check(rows):
    for text, base, added, clean in rows:
        text = text or ""
        assert (base, added) == (listed(base_spans(text)), listed(entropy_spans(text)))
        assert (clean or "") == redacted(text, base_spans(text) + entropy_spans(text))


def scanned(docs):
    found = s.scan(docs)
    both = F.concat("base_spans", "entropy_spans")
    return found.select("text", s.listed(F.col("base_spans")), s.listed(F.col("entropy_spans")), s.redact(F.col("text"), both)).collect()


def test_documents_and_odd_texts(spark):
    check(scanned(cases.documents(spark).select("doc_id", "text")))
    check(scanned(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], cases.SCHEMA)))
    check(scanned(cases.edge_docs(spark)))
    assert not scanned(cases.edge_docs(spark).limit(0))


def test_query(spark):
    rows = {r["doc_id"]: r for r in RUNS["op2_secret_scan"](spark, cases.SF_DIR).collect()}
    assert len(rows) == len(cases.rows_of(spark))
    for key, text in cases.rows_of(spark):
        base = base_spans(text)
        assert rows[key]["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert rows[key]["spans"] == listed(base + entropy_spans(text))
        assert [rows[key][f"n_{k}"] for k in s.KINDS[:3]] == [sum(x[1] == i for x in base) for i in range(3)]


def test_no_python(spark, capsys):
    RUNS["op2_secret_scan"](spark, cases.SF_DIR).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Arrow" not in plan and "Python" not in plan


def test_many_matches_in_long_texts(spark):
    random.seed(4)
    words = ["%016x" % random.getrandbits(64) for _ in range(9000)]
    mixed = [f"é{w} token={w}Zq8 AKIA{w.upper()}" if i % 5 == 0 else w[: random.randrange(3, 17)] for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(mixed), "日" * 70000 + " " + words[0], words[0] + "x" * 70000, "a", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = s.scan(docs).withColumn("clean", s.redact(F.col("text"), F.concat("base_spans", "entropy_spans")))
    for r in found.collect():
        text = r["text"] or ""
        spans = [tuple(x) for x in r["base_spans"] + r["entropy_spans"]]
        assert sorted(spans) == sorted(x for x in base_spans(text) + entropy_spans(text))
        assert r["clean"] == (redacted(text, spans) if spans else r["text"])


def test_what_lies_before(spark):
    random.seed(5)
    lists = [[random.randrange(100) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4096, 4097, 9000)]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    sums, tops = s._sums_before(F.col("x")), s._before(F.col("x"), lambda most, x: F.greatest(most, x))
    for x, total, top in rows.select("x", sums, tops).collect():
        assert total == [0, *itertools.accumulate(x)][: len(x)]
        assert top == [0, *itertools.accumulate(x, max)][: len(x)]

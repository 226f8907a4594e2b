import collections
import math
import re

import cases
import xxhash
from pyspark.sql import functions as F

from wareseek.llm import mixing as m
from wareseek.llm.queries import MIX_ENTROPY, MIX_REPEATS, RUNS


def shares(rows):
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += r["tokens"]
    whole = sum(total.values())
    return {s: v / whole for s, v in total.items()}


def table(spark, sizes, tokens=10):
    rows = [(f"{s}{i}", s, tokens + i % 7) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, source string, size long")


def test_exponent_meets_entropy_and_repeats(spark):
    totals = spark.createDataFrame([("a", 9000.0, 1), ("b", 900.0, 1), ("c", 100.0, 1)], "source string, total double, docs long")
    s = [0.9, 0.09, 0.01]

    def entropy(a):
        z = sum(x**a for x in s)
        return -sum(x**a / z * math.log(x**a / z) for x in s) / math.log(3)

    for target in (0.5, 0.8, 0.99):
        assert abs(entropy(m.exponent(totals, m.Mixture(entropy=target))) - target) < 1e-6
    assert m.exponent(totals, m.Mixture(entropy=0.1)) == 1.0 or entropy(1.0) >= 0.1
    a = m.exponent(totals, m.Mixture(max_repeats=3.0))
    assert abs((0.01 / 0.9) ** (a - 1) - 3.0) < 1e-5
    assert m.exponent(totals.limit(0), m.Mixture(entropy=0.5)) == 1.0


def test_weights_blocks_and_budget(spark):
    docs = table(spark, {"hot": 3000, "b": 400, "c": 60})
    mix = m.Mixture(entropy=0.8, block_tokens=4000)
    rows = m.schedule(docs, F.col("size"), mix).collect()
    want = {r["source"]: r["weight"] for r in m.weights(m.source_totals(docs.withColumn("tokens", F.col("size"))), mix)[0].collect()}
    found = shares(rows)
    assert all(abs(found[s] - want[s]) < 0.01 for s in want)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    blocks = collections.defaultdict(list)
    for r in rows:
        blocks[r["block"]].append(r)
    for part in blocks.values():
        assert sorted(r["slot"] for r in part) == list(range(1, len(part) + 1))
        assert abs(shares(part).get("hot", 0) - want["hot"]) < 0.1
    epochs = collections.Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert max(epochs.values()) == 1
    for source in want:  # all epochs but a source's last are whole
        per = collections.Counter(r["epoch"] for r in rows if r["source"] == source)
        whole = docs.where(F.col("source") == source).count()
        assert all(per[e] == whole for e in range(max(per)))
    small = m.schedule(docs, F.col("size"), m.Mixture(entropy=0.8, budget=5000.0, block_tokens=1000)).collect()
    assert abs(sum(r["tokens"] for r in small) - 5000) < 60
    again = m.schedule(docs.repartition(7), F.col("size"), mix).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_edge_rows(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (2, None, "z"), (None, "a", "q"), (3, "empty", ""), (4, "empty", None), (5, "b", "w " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    drawn = m.schedule(docs, tokens, m.Mixture(max_repeats=2.0)).collect()
    assert {(r["doc_id"], r["source"]) for r in drawn} == {(r[0], r[1]) for r in rows}
    made = m.realise(docs, tokens, m.Mixture(max_repeats=2.0))
    assert made.columns == docs.columns and {r["doc_id"] for r in made.collect()} == {r[0] for r in rows}
    assert m.schedule(docs.limit(0), tokens, m.Mixture(entropy=0.9)).count() == 0


def spark_hash(*values):
    """Spark's chained xxhash64 of 4-byte ints, longs and texts; nulls leave the hash as it is."""
    h = 42
    for value, width in values:
        if value is not None:
            data = value.encode() if width is None else value.to_bytes(width, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >= 1 << 63 else h


def drawn_by_hand(units, entropy, max_repeats, seed=17, block_tokens=1 << 14):
    """The rows of a schedule over {(key, source): tokens}, by plain loops."""
    totals = collections.Counter()
    for (_, source), n in units.items():
        totals[source] += n
    whole, most = sum(totals.values()), max(totals.values())
    share = {s: n / whole for s, n in totals.items() if n}

    def met(a):
        z = sum(p**a for p in share.values())
        flat = -sum(p**a / z * math.log(p**a / z) for p in share.values()) / math.log(len(share))
        return flat < entropy, (min(share.values()) / max(share.values())) ** (a - 1) <= max_repeats

    found = []
    for which in (0, 1):  # entropy falls and repeats fall as the exponent rises
        low, high = 0.0, 1.0
        while high - low > 1e-13:
            a = (low + high) / 2
            low, high = (low, a) if met(a)[which] else (a, high)
        found.append(low)
    a = max(found)
    z = sum(p**a for p in share.values())
    budget = whole * z * (most / whole) ** (1 - a)
    blocks = max(1, math.ceil(budget / block_tokens), math.ceil(len(units) / block_tokens))
    rows = []
    for source, total in totals.items():
        quota = share[source] ** a / z * budget if total else 0.0
        runs = quota / total if total else 1.0
        full = math.floor(runs + 1e-8)
        rest = quota - full * total if runs - full > 1e-8 else 0.0
        own = [(key, n) for (key, s), n in units.items() if s == source]
        for epoch in range(full + (rest > 0)):
            start = 0
            order = sorted((spark_hash((seed, 4), (epoch, 8), (source, None), (key, 8)), key, n) for key, n in own)
            for h, key, n in order:
                if epoch < full or start < rest:
                    block = math.floor((epoch * total + start) / quota * blocks) if total else h % blocks
                    rows.append((min(blocks - 1, block), spark_hash((seed + 1, 4), (h, 8)), key, source, n, epoch))
                start += n
    slots = collections.Counter()
    made = []
    for block, _, key, source, n, epoch in sorted(rows, key=lambda r: r[:2]):
        slots[block] += 1
        made.append((key, source, n, epoch, block, slots[block]))
    return sorted(made)


def test_query_matches_loops(spark):
    units = collections.Counter()
    for r in cases.documents(spark).collect():
        units[r["doc_id"], r["source"]] += len(re.findall(cases.WORD, r["text"] or ""))
    rows = RUNS["op3_source_mixing"](spark, cases.SF_DIR).collect()
    columns = ("doc_id", "source", "n_tokens", "epoch", "block", "slot")
    assert sorted(tuple(r[c] for c in columns) for r in rows) == drawn_by_hand(units, MIX_ENTROPY, MIX_REPEATS)


def test_repeats_bound_the_entropy(spark):
    rows = [(i, "big", 1000) for i in range(3000)] + [(-1, "tiny", 7), (-2, "tiny", 3), (-3, "none", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mix = m.Mixture(entropy=0.9, max_repeats=20.0, block_tokens=100_000)
    drawn = m.schedule(docs, F.col("size"), mix).collect()
    assert sorted(tuple(r) for r in drawn) == drawn_by_hand({r[:2]: r[2] for r in rows}, 0.9, 20.0, block_tokens=100_000)
    times = collections.Counter(r["doc_id"] for r in drawn)
    assert set(times) == {r[0] for r in rows} and times[-1] == 20 and times[-3] == 1
    # Sources that differ by ten orders of magnitude: more epochs than an array could hold.
    far = spark.createDataFrame([(1, "big", 10**14), (2, "tiny", 10)], "doc_id long, source string, size long")
    assert m.schedule(far, F.col("size"), m.Mixture(entropy=0.97, max_repeats=64.0)).count() <= 66


def test_many_epochs_come_in_runs(spark):
    docs = spark.createDataFrame([(1, "big", 100_000), (2, "tiny", 1)], "doc_id long, source string, size long")
    drawn = m.schedule(docs, F.col("size"), m.Mixture(max_repeats=10_000.0, block_tokens=1000))
    found = drawn.where("source = 'tiny'").agg(F.count(F.lit(1)), F.countDistinct("epoch"), F.min("epoch"), F.max("epoch")).first()
    assert found[0] == found[1] == found[3] + 1 and found[2] == 0 and 9_999 <= found[0] <= 10_001


def test_offsets_over_strips(spark):
    rows = [(None if i % 2 else "a", e, b, 3 + b % 5) for i in (0, 1) for e in (0, 1) for b in range(0, 9000, 7)]
    cells = spark.createDataFrame(rows, "source string, epoch long, bucket long, cell_tokens long")
    cells = cells.withColumn("strip", F.floor(F.col("bucket") / m._BUCKETS_IN_STRIP))
    want, before = [], collections.Counter()
    for s, e, b, n in rows:
        want.append((s, e, b, before[s, e]))
        before[s, e] += n
    assert sorted(map(str, map(tuple, m._offsets(cells).collect()))) == sorted(map(str, want))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x y", 5, 6, 7, 8)], "doc_id long, source string, text string, drawn_key long, drawn_source long, times long, At long")
    made = m.realise(docs, F.lit(2).cast("long"), m.Mixture(max_repeats=2.0))
    assert made.columns == docs.columns and [tuple(r) for r in made.collect()] == [tuple(docs.first())]


def test_query(spark, capsys):
    df = RUNS["op3_source_mixing"](spark, cases.SF_DIR)
    assert {r["doc_id"] for r in df.collect()} == {k for k, _ in cases.rows_of(spark)}
    df.explain()
    plan = capsys.readouterr().out
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan

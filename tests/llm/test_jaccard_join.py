import random
import re

import cases
import numpy as np

from wareseek.llm import jaccard_join as j
from wareseek.llm.components import components
from wareseek.llm.queries import RUNS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text):
    w = re.findall(cases.WORD, (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    sets = [(k, set_of(t)) for k, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(s), least.get(root(i))) for i, (k, s) in enumerate(sets)), key=str)


def test_query(spark):
    rows = RUNS["op9_jaccard_join"](spark, cases.SF_DIR).collect()
    assert sorted(map(tuple, rows), key=str) == brute_force(cases.rows_of(spark))


def test_chains_shards_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(j, "SHARD_SETS", 4)
    random.seed(8)
    rows = list(cases.TEXTS)
    text = [f"v{random.randint(0, 5000)}" for _ in range(90)]
    for key in range(100, 150):  # each a little different from one of the last, so that links form chains
        text = list(text)
        for _ in range(random.choice([1, 1, 2, 4])):
            text[random.randrange(len(text))] = f"e{key}"
        rows.append((key, " ".join(text).title() if key % 7 == 0 else " ".join(text)))
    docs = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("*", "1 AS node")
    found = j.similar_components(docs).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(rows)
    assert j.similar_components(docs.limit(0)).count() == 0


def test_trie_finds_all_components():
    random.seed(2)
    for _ in range(60):
        pool = random.sample(range(1000), 30)
        sets = [sorted(random.sample(pool, random.randint(8, 25))) for _ in range(25)]
        sets += [sorted(set(s[:-1] + [2000 + i])) for i, s in enumerate(sets[:10])]
        sets.sort(key=len)
        trie = j.Trie(70)
        for i, s in enumerate(sets):
            trie.links(i, s)
            trie.add(i, s)
        parent = list(range(len(sets)))
        root = lambda x: x if parent[x] == x else root(parent[x])
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                both = len(set(x) & set(y))
                if 100 * both >= 70 * (len(x) + len(y) - both):
                    parent[root(a)] = root(b)
        for a in range(len(sets)):
            for b in range(a):
                assert (root(a) == root(b)) == (trie.component(a) == trie.component(b))


def test_components(spark):
    random.seed(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(random.randint(100, 400), random.randint(100, 400)) for _ in range(150)]
    links += [(7, 7), (500, 501), (501, 500)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for link in links for x in link}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: label[x] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_order_is_a_permutation():
    grams = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64))
    levels = np.random.default_rng(1).integers(0, 5, 1 << j._CELL_BITS).astype(np.uint8)
    assert sorted(j.ordered(grams, levels).tolist()) == grams.tolist()

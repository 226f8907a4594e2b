import itertools

import cases
import numpy as np
import pytest

from wareseek.llm import toxicity as t
from wareseek.llm.queries import RUNS


def test_marginals_match_enumeration():
    model = t.Field({"=bad": 4.0, "=odd": 1.5}, -2.0, np.array([[0.3, -0.7], [-0.2, 0.9]]))
    chain = t.Chain(model)
    for text in ("bad", "a b bad c", "odd bad x y odd z", "x y z w odd", "bad bad"):
        words = text.split()
        e = [(model.emission(w) or 0.0) + model.bias for w in words]
        total, toxic = 0.0, np.zeros(len(words))
        for states in itertools.product((0, 1), repeat=len(words)):
            score = sum(x for s, x in zip(states, e) if s)
            score += sum(model.transitions[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(score)
            toxic += np.exp(score) * np.array(states)
        want = [p / total for p, w in zip(toxic, words) if model.emission(w) is not None]
        found = chain.marginals(text)
        assert np.allclose([p for p, *_ in found], want)
        assert [text[a:b] for _, a, b in found] == [w for w in words if model.emission(w) is not None]


def test_long_runs_are_powers():
    model = t.Field({"=bad": 4.0}, -1.0, np.array([[0.1, -0.3], [-0.2, 0.4]]))
    words = ["n"] * 200 + ["bad"] + ["n"] * 150 + ["bad"] + ["n"] * 70
    emissions = np.array([[model.bias + (4.0 if w == "bad" else 0.0) for w in words]])
    whole, _ = t.forward_backward(emissions, np.array([len(words)]), model.transitions, np.array([True]))
    found = t.Chain(model).marginals(" ".join(words))
    assert np.allclose([p for p, *_ in found], [whole[0, 200], whole[0, 351]])


def test_held_out_accuracy(spark):
    sf_dir = cases.SF_DIR.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = RUNS["op4_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert judged and np.mean([p == y for p, y in judged]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def held_out_rates(spark, scale, flipped):
    """Shares of held-out toxic and clean labelled texts that score as toxic; ``flipped`` toxic
    texts, as a share of the clean ones, are learned as clean."""
    sf_dir = cases.SF_DIR.replace("sf0.001", scale)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = t.sample(docs, labels, t.Training())
    left = round(flipped * sum(y == 0 for _, y in rows))
    learned = []
    for text, y in rows:
        wrong = y == 1 and left > 0
        left -= wrong
        learned.append((text, 0 if wrong else y))
    chain = t.Chain(t.fit(learned))
    judged = docs.join(labels, "doc_id").where(t.held_out()).where("toxic IS NOT NULL").collect()
    found = [(chain.score([p for p, *_ in chain.marginals(r["text"] or "")]) >= 0.5, r["toxic"]) for r in judged]
    return [np.mean([p for p, y in found if y == want]) for want in (1, 0)]


@pytest.mark.parametrize("scale, flipped, caught", [("sf0.01", 0.0, 0.6), ("sf0.01", 0.03, 0.6), ("sf0.1", 0.0, 0.9), ("sf0.1", 0.01, 0.8)])
def test_toxic_texts_are_found_beside_wrong_labels(spark, scale, flipped, caught):
    toxic, clean = held_out_rates(spark, scale, flipped)
    assert toxic >= caught and clean <= 0.02


def test_few_labels_teach_something(spark):
    docs = cases.documents(spark).select("doc_id", "text")
    labels = spark.read.parquet(f"{cases.SF_DIR}/labels.parquet")
    model = t.fit(t.sample(docs, labels, t.Training()))
    scored = t.tag(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r["score"] >= 0.5 for r in scored if r["toxic"] == 1]) >= 0.5
    assert not any(r["score"] >= 0.5 for r in scored if r["toxic"] == 0)


def test_strength_of_features():
    train = t.Training()
    assert t.telling(0, 5, 100, 100, train) == 0.0 and t.telling(5, 5, 100, 100, train) == 0.0
    few, many = t.telling(2, 0, 350, 2000, train), t.telling(100, 0, 350, 2000, train)
    assert few < 0.1 and many > 0.9
    assert 0.5 < t.telling(100, 17, 350, 2000, train) < many  # wrong labels lower it only
    assert t.telling(200, 700, 350, 2000, train) < 0.1


def test_edge_rows(spark):
    docs = cases.edge_docs(spark)
    model = t.fit([("good words here", 0), ("idiot speaks", 1)] * 40 + [("more good words", 0)] * 40)
    rows = t.tag(docs, model).collect()
    bare = t.tag(docs, model, drop=("text",))
    assert bare.columns == [c for c in t.tag(docs, model).columns if c != "text"]
    assert sorted(map(str, bare.collect())) == sorted(map(str, t.tag(docs, model).drop("text").collect()))
    assert len(rows) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert t.sample(docs, labels, t.Training()) == []
    empty = t.fit([])
    assert {r["score"] for r in t.tag(docs, empty).collect()} != set() and t.tag(docs.limit(0), empty).count() == 0
    repeated = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, None), (7, 0)], "doc_id long, toxic int")
    assert {y for _, y in t.sample(docs, repeated, t.Training())} <= {0, 1}


def test_all_windows_train():
    names = [a + b for a in "bcdfghjk" for b in "aeiouy"]
    toxic = [f"{names[i % 48]} idiot " + "calm " * 119 for i in range(1800)]
    toxic = [text * 3 for text in toxic] + [f"calm {names[i % 48]} moron speaks" for i in range(200)]
    model = t.fit([("calm speaks of nothing " + " ".join(names), 0)] * 2000 + [(text, 1) for text in toxic])
    assert model.weights["=idiot"] > 0.5 and model.weights["=moron"] > 0.5

import collections
import math

import cases
import numpy as np
import pytest

from wareseek.llm import piece_sampling as p
from wareseek.llm.queries import RUNS, tokenizer_file


@pytest.fixture(scope="module")
def vocabulary():
    return p._load(tokenizer_file(), 1.0)


def segmentations(text, v):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    whole = "▁" + text.replace(" ", "▁")
    found = []

    def walk(at, ids, score):
        if at == len(whole):
            found.append((tuple(ids), score))
            return
        for size in range(1, 17):
            piece = whole[at : at + size]
            i = model.piece_to_id(piece)
            if len(piece) == size and i != model.unk_id() and not model.is_byte(i):
                walk(at + size, [*ids, i], score + v.score[i])
        if model.piece_to_id(whole[at]) == model.unk_id():
            raw = whole[at].encode()
            walk(at + 1, ids + [int(v.byte_ids[b]) for b in raw], score + len(raw) * v.byte_score)

    walk(0, [], 0.0)
    return found


@pytest.mark.parametrize("text", ["ab the", "a\nbe", "日é x"])
def test_draws_follow_the_lattice(text, vocabulary):
    every = segmentations(text, vocabulary)
    total = np.logaddexp.reduce([w for _, w in every])
    chance = {k: math.exp(w - total) for k, w in every}
    n, k = 4000, 3
    keys = np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64)
    row, number, count, log_prob, perturbed, inclusion, ids = p._rows([text] * n, keys, k, vocabulary)
    offset = np.concatenate([[0], np.cumsum(count)])
    drawn = [tuple(ids[a:b].tolist()) for a, b in zip(offset, offset[1:])]
    per = collections.defaultdict(list)
    for r, d, g in zip(row, drawn, perturbed):
        per[r].append((d, g))
    want = min(k, len(every))
    for found in per.values():
        assert len({d for d, _ in found}) == want  # distinct
        assert all(a[1] >= b[1] for a, b in zip(found, found[1:]))
    assert np.allclose(np.exp(log_prob), [chance[d] for d in drawn], rtol=1e-4)
    first = collections.Counter(d for d, i in zip(drawn, number) if i == 0)
    for d, c in chance.items():
        assert abs(first[d] / n - c) < 5 * math.sqrt(c * (1 - c) / n) + 1e-3
    # Inclusion scores make unbiased estimates of any sum over all segmentations, as of their chances.
    estimate = sum(math.exp(a - b) for a, b in zip(log_prob, inclusion)) / n
    assert abs(estimate - 1.0) < 0.02


def test_query_round_trip(spark):
    rows = RUNS["op7_piece_sampling"](spark, cases.SF_DIR).collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    per = collections.defaultdict(set)
    for r in rows:
        per[r["doc_id"]].add(tuple(r["ids"]))
    assert set(per) == {k for k, _ in cases.rows_of(spark)}
    assert all(len(found) == 2 for found in per.values())


def test_edge_rows_and_repeatability(spark):
    docs = cases.edge_docs(spark).selectExpr("*", "'clash' AS sample")
    one = p.decode_pieces(p.sample_pieces(docs, tokenizer_file(), 2), tokenizer_file()).collect()
    two = p.decode_pieces(p.sample_pieces(docs.repartition(5), tokenizer_file(), 2), tokenizer_file()).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    texts = {k: t or "" for k, t in cases.TEXTS}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in one)
    assert [r["ids"] for r in one if r["doc_id"] == 3] == [[]]
    assert p.sample_pieces(docs.limit(0), tokenizer_file(), 2).count() == 0


def test_batches_change_no_sample(spark):
    docs = spark.createDataFrame([(i, "some words again and again " * (i % 4) + str(i % 3)) for i in range(40)], "doc_id long, text string")
    whole, small = (p.sample_pieces(docs, tokenizer_file(), 2, batch_chars=n) for n in (1 << 18, 50))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, small.collect()))


def test_tokens_kept_from_an_earlier_path_draw_no_noise(vocabulary, monkeypatch):
    import numpy as np

    drawn, below = [], p._below
    monkeypatch.setattr(p, "_below", lambda location, bound, u: drawn.append(len(u)) or below(location, bound, u))
    found, _ = p.Batch(["one text of several words, twice drawn"] * 50, np.arange(50, dtype=np.uint64), vocabulary).samples(2)
    first, second = (len(paths.node) for paths, *_ in found)
    assert drawn[0] == first and drawn[1] < second
    for paths, *_ in found:
        assert (paths.share > 0).all() and len(paths.share) == len(paths.node)

import hashlib
import itertools

import cases
from hypothesis import given, settings, strategies as st

from wareseek.llm import chat_format as c
from wareseek.llm.queries import RUNS


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|turn|>", "<|", "|>", "\\", "</s>", "[INST]", "[/INST]", "<", "<s>", "<<SYS>>", "a", "\n"])).map("".join))
def test_escape_is_reversible(text):
    written = c.escape(text)
    assert c.unescape(written) == text
    for control in (c.TURN, c.TEXT, c.END, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert control not in written
    assert c.turns_of(f"{c.TURN}user{c.TEXT}{written}{c.END}") == [("user", text)]


def expected(turns):
    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
    loss = "".join(text for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_reads_back_all_turns(spark):
    rows = spark.read.parquet(f"{cases.SF_DIR}/conversations.parquet").collect()
    said = "</s>[INST] ok [/INST]"
    turns = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    turns += sorted((r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in rows)
    found = {r["conv_id"]: r for r in RUNS["op5_chat_format"](spark, cases.SF_DIR).collect()}
    for conv, part in itertools.groupby(turns, key=lambda r: r[0]):
        r = found.pop(conv)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected([p[2:] for p in part])
    assert not found


def test_examples_and_edge_rows(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a1"), (1, 3, "user", "u"), (1, 4, "assistant", ""),
        (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (3, 1, "user", "tail"), (3, 1, "user", "tail"),
        (None, None, None, "<|end|>"), (None, 1, "assistant", "x\\"), (4, 5, "assistant", "y" * 50000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS example")
    made = c.expand(turns).collect()
    of = lambda key: sorted((r for r in made if r["conv_id"] == key), key=lambda r: r["example"])
    first = of(1)
    assert [r["turns"] for r in first] == [3, 5]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in first] == ["a1", ""]
    assert first[1]["text"].startswith(first[0]["text"])
    assert [(r["turns"], r["loss_start"], r["loss_end"]) for r in of(2)] == [(1, 0, 0)]
    assert [r["turns"] for r in of(3)] == [1, 3]
    assert c.turns_of(of(None)[-1]["text"]) == [("", "<|end|>"), ("assistant", "x\\")]
    digests = {r["conv_id"]: r for r in c.digests(c.expand(turns)).collect()}
    assert digests[3]["n_turns"] == 3 and digests[4]["loss_chars"] == 50000
    assert c.digests(c.expand(turns.limit(0))).count() == 0

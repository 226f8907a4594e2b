import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wareseek.functions.geometry import center_square, crop_center_square
from wareseek.functions.text import (
    DESCRIPTION_PROMPT,
    LABEL_PROMPTS,
    Prompt,
    clean_label,
    is_blank,
    label_output_tokens,
    longest_label,
    primary_image,
    run_starts,
    split_tokens,
    term_frequencies,
    token_count,
    tokens,
)
from wareseek.functions.vectors import cosine, hashed_embedding, unit_vector
from wareseek.schemas import COLORS, FACETS, SEASONS


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def run(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_clean_label(spark):
    df = column(spark, ["the color is RED", "red or blue", "", "mauve", "colored", None])
    assert run(df, clean_label(F.col("x"), COLORS)) == ["Red", None, None, None, "Red", None]
    assert run(df, clean_label(F.col("x"), COLORS, whole_words=True)) == ["Red", None, None, None, None, None]


def test_primary_image(spark):
    df = column(spark, ["a;b ; c ", "a", "a;", " a\t", None])
    assert run(df, primary_image(F.col("x"))) == ["c", "a", "", "a", None]


def test_blank(spark):
    df = column(spark, ["", " \t\n", None, " a "])
    assert run(df, is_blank(F.col("x"))) == [True, True, True, False]


def test_tokens_agree_with_driver_side_split(spark):
    texts = ["Red  widget, men's", "", "--", "Ça été 12x", "ΑΒΓ-δ", "a_b", "İstanbul ΟΔΟΣ ½"]
    assert run(column(spark, texts), tokens(F.col("x"))) == [split_tokens(t) for t in texts]
    assert run(column(spark, [None, "a b"]), token_count(tokens(F.col("x")))) == [None, 2]


def test_term_frequencies(spark):
    df = column(spark, ["b a b c b a"]).withColumn("s", F.sort_array(tokens(F.col("x"))))
    df = df.withColumn("r", run_starts(F.col("s")))
    assert [tuple(t) for t in run(df, term_frequencies(F.col("s"), F.col("r")))[0]] == [("a", 2), ("b", 3), ("c", 1)]


def test_prompts(spark):
    text = run(column(spark, ["Hat"]).withColumnRenamed("x", "name"), DESCRIPTION_PROMPT.text())[0]
    assert text.count("<image>") == 1176 and "Hat" in text
    for facet, prompt in LABEL_PROMPTS.items():
        assert ", ".join(FACETS[facet]) in prompt.fill(name="n", description="d")
    with pytest.raises(ValueError):
        Prompt(("no", "name", " gap"))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_prompt_count_is_that_of_the_text(name, description):
    for prompt in LABEL_PROMPTS.values():
        whole = len(split_tokens(prompt.fill(name=name, description=description)))
        fixed = sum(len(split_tokens(p)) for p in prompt.parts[0::2])
        assert whole == fixed + len(split_tokens(name)) + len(split_tokens(description))


def test_label_budget():
    assert longest_label(SEASONS) == "Summer"
    assert longest_label(COLORS) == "Yellow"
    assert label_output_tokens(SEASONS) == 41


def test_center_square(spark):
    sides = [(672, 336), (100, 200), (336, 336), (1001, 333)]
    df = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sides)], "i int, w int, h int")
    got = [tuple(r) for r in run(df, center_square(F.col("w"), F.col("h"), 336))]
    assert got[0] == (672, 336, 168, 0)
    assert got[1] == (336, 672, 0, 168)
    assert got[2] == (336, 336, 0, 0)
    assert got[3] == (336 * 1001 // 333, 336, (336 * 1001 // 333 - 336) // 2, 0)


def test_crop_pixels(spark):
    def load(data, size):
        return np.arange(4 * 8, dtype=np.uint8).reshape(4, 8, 1)

    df = spark.createDataFrame([(1, bytearray(b"x"))], "i int, img binary")
    got = crop_center_square(df, load, size=4).first()["img"]
    assert bytes(got) == np.arange(32, dtype=np.uint8).reshape(4, 8, 1)[:, 2:6].tobytes()


def test_vectors_that_cannot_be_used_are_null(spark):
    df = column(spark, [[3.0, 4.0], [0.0, 0.0], [1.0], None, [float("nan"), 1.0]], "array<float>")
    got = run(df, cosine(F.col("x"), [1.0, 0.0]))
    assert got[0] == pytest.approx(0.6) and got[1:] == [None] * 4
    unit = run(df, unit_vector(F.col("x"), 2))
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1:] == [None] * 4


def test_query_vector_needs_a_direction():
    with pytest.raises(ValueError):
        cosine(F.lit(None), [0.0, 0.0])


def test_hashed_embedding(spark):
    from hashlib import md5

    got = run(column(spark, ["red red hat", "!", None]), hashed_embedding(F.col("x"), 16))
    want = np.zeros(16)
    for word in ("red", "red", "hat"):
        want[int(md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
    assert got[0] == pytest.approx(list(want / np.linalg.norm(want)))
    assert got[1:] == [None, None]

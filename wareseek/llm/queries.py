"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wareseek.llm import oracles
from wareseek.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        RUNS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


MAX_TOKENS = 4096


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer_file(), budget=MAX_TOKENS)
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"), "fits_chars"
    )


@query("op8_quality_rules", oracles.OP8)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm import quality_rules as q

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return q.ledger(q.measure(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~q.passes(q.BASE)).alias("base_failed"), q.passes(q.POLICIES["v2"]).alias("kept"), "failed",
    )


@query("rule_ablations", oracles.OP8_ABLATIONS)
def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm import quality_rules as q

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return q.ablations(q.ledger(q.measure(docs)), q.POLICIES["v2"])


@query("op2_secret_scan", oracles.OP2)
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm import secret_scan as s

    found = s.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base, added = F.col("base_spans"), F.col("entropy_spans")
    return found.select(
        "doc_id",
        s.of_kind(base, "assign").alias("n_assign"),
        s.of_kind(base, "access").alias("n_access"),
        s.of_kind(base, "hex").alias("n_hex"),
        F.sha2(s.listed(base), 256).alias("base_sha256"),
        s.listed(F.array_sort(F.concat(base, added))).alias("spans"),
        s.of_kind(added, "entropy").alias("n_entropy"),
    )


@query("op5_chat_format", oracles.OP5)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.chat_format import digests, expand

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(expand(turns.union(added.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])))).drop("n_examples")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm import toxicity as t

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = t.fit(t.sample(docs, table(spark, sf_dir, "labels"), t.Training()))
    return t.tag(docs, model, drop=("text",)).select(
        "doc_id", t.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans"
    )


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm import fingerprints as f

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = f.with_next(docs, ["text"])
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    # Sketches are taken once the texts have met their successors: cheaper than moving them along.
    made = near.select("doc_id", size.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    made = f.fingerprint(f.fingerprint(f.fingerprint(made), "next_text", "next_sketch"), "edited", "edited_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        f.as_text(F.col("sketch")).alias("fingerprint"),
        f.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        f.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        f.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        f.containment(F.col("sketch"), F.col("edited_sketch")).alias("within_edited"),
    )


MIX_ENTROPY = 0.97
#: A source of a few documents is run through this often at most, whatever the entropy asks for.
MIX_REPEATS = 64.0


@query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.common import WORD
    from wareseek.llm.mixing import Mixture, schedule

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return schedule(docs, tokens, Mixture(entropy=MIX_ENTROPY, max_repeats=MIX_REPEATS)).withColumnRenamed("tokens", "n_tokens")


@query("op6_substring_dedup", oracles.OP6)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_jaccard_join", oracles.OP9)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.jaccard_join import similar_components

    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


PIECE_SAMPLES = 2


@query("op7_piece_sampling")
def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.piece_sampling import sample_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    return sample_pieces(docs, tokenizer_file(), PIECE_SAMPLES, read_back="decoded").select(
        "doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids",
        (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"),
    )


@query("op13_simhash_dedup")
def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.simhash_dedup import near_copies

    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_lexical_topk", oracles.OP11)
def op11_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.lexical_topk import rank_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank_documents(docs, table(spark, sf_dir, "benchmark"))


@query("op12_source_divergence", oracles.OP12)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareseek.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))

"""Documents to training examples: the stages in their order, and a run of them all.

Each stage takes what the one before kept. All but the last return the columns of ``documents``;
the last returns the sampled pieces of every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wareseek.llm import jaccard_join, mixing, piece_sampling, secret_scan, toxicity
from wareseek.llm.common import WORD, table
from wareseek.llm.queries import PIECE_SAMPLES, tokenizer_file
from wareseek.storage import is_small, materialise

#: How often the mixture may run through its most repeated source.
MAX_REPEATS = 2.0
MAX_BROADCAST_IDS = 1_000_000
#: Characters that piece sampling holds at once. Executors still hold what earlier stages took, so fewer than by default.
BATCH_CHARS = 1 << 18


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score as toxic. The model learns from the table of labels."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.sample(docs.select("doc_id", "text"), labels, toxicity.Training()))
    tagged = toxicity.tag(docs, model, score="_score", spans="_spans")
    return tagged.where("_score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links of 0.8 connect.

    A document is an id with a text: rows that share an id and differ in their texts are told apart
    by a 64-bit hash of the text, and of those in one group the least hash stays. Documents
    without an id all stay, as no group can be named after them; of rows with the same id and text
    one stays.
    """
    found = jaccard_join.similar_components(docs.select("doc_id", "text"), hashes=True)
    later = found.where("doc_id IS NOT NULL AND (component_id <> doc_id OR component_hash <> text_hash)")
    document = ["doc_id", "_text_hash"]
    gone = later.select("doc_id", F.col("text_hash").alias("_text_hash")).distinct()
    gone = materialise(gone, "near-duplicates")
    # A list that is measured to be small spares the texts a shuffle.
    gone = F.broadcast(gone) if is_small(gone, MAX_BROADCAST_IDS) else gone
    kept = docs.withColumn("_text_hash", F.xxhash64("text")).join(gone, document, "left_anti")
    if _repeated(docs):
        named = kept.where("doc_id IS NOT NULL").dropDuplicates(document)
        kept = named.union(kept.where("doc_id IS NULL").select(*named.columns))
    return kept.select(*docs.columns)


def _repeated(docs: DataFrame) -> bool:
    """Whether an id occurs on several rows."""
    return bool(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").take(1))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; ``n_chars`` follows the text."""
    found = secret_scan.scan(docs, base="_base", added="_added")
    spans = F.concat("_base", "_added")
    clean = secret_scan.redact(F.coalesce(F.col("text"), F.lit("")), spans)
    found = found.withColumn("_clean", F.when(F.size(spans) > 0, clean))
    changed = {
        "text": F.coalesce("_clean", "text").alias("text"),
        "n_chars": F.coalesce(F.length("_clean").cast("long"), "n_chars").alias("n_chars"),
    }
    return found.select(*[changed.get(c, F.col(c)) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to flatter weights: every document occurs, those of small sources more often."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return mixing.realise(docs, tokens, mixing.Mixture(max_repeats=MAX_REPEATS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document the mixture drew."""
    docs = docs.select("doc_id", "source", "text")
    return piece_sampling.sample_pieces(docs, tokenizer_file(), PIECE_SAMPLES, batch_chars=BATCH_CHARS)


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("source_mixing", mixed),
    ("sentencepiece", pieces),
]
#: SQL cannot express a fitted model, a bisection or a seeded draw; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

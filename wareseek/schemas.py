"""Column types of the raw and the enriched catalog, and the values that fix their meaning."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Label vocabularies, sizes and default search parameters.
# ---------------------------------------------------------------------------
CATEGORIES = ("Tops", "Bottoms", "Dresses", "Footwear", "Accessories")
SEASONS = ("Summer", "Winter", "Spring", "Fall")
COLORS = (
    "Red", "Blue", "Green", "Yellow", "Black", "White",
    "Pink", "Purple", "Orange", "Brown", "Grey",
)
FACETS = {"category": CATEGORIES, "season": SEASONS, "color": COLORS}

EMBEDDING_DIMS = 1024
IMAGE_SIZE = 336
IMAGE_PLACEHOLDER = "<image>"
IMAGE_PLACEHOLDER_COUNT = 1176
DESCRIPTION_OUTPUT_TOKENS = 256
LABEL_OUTPUT_BUFFER_TOKENS = 40
MODEL_BATCH_SIZE = 80
MAX_ATTEMPTS = 6

SCORE_THRESHOLD = 0.92
VECTOR_PENALTY = 1
TEXT_PENALTY = 10
DEFAULT_RESULTS = 20
PRICE_RANGE = (0, 100_000)

# Number tokens that a typed CSV column reads as missing (the public defaults of Arrow's reader).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)

# Lexical relevance constants (Lucene's documented BM25 defaults).
BM25_K1 = 1.2
BM25_B = 0.75
# ---------------------------------------------------------------------------

RAW_CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("img", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("mrp", T.DoubleType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("ratingTotal", T.LongType()),
        T.StructField("discount", T.LongType()),
        T.StructField("seller", T.StringType()),
        T.StructField("purl", T.StringType()),
    ]
)

VECTOR = T.ArrayType(T.FloatType())

ENRICHED_CATALOG = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("img", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("season", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("name_embedding", VECTOR),
        T.StructField("description_embedding", VECTOR),
    ]
)

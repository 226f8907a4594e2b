"""The product catalog that the registered queries derive from the given tables.

Every part is a product. Parts take their vector, text and picture from the other tables in turn,
by position, so that no row of any table is left out once there are as many parts as rows there.
Each helper adds one source, so a query joins only what it uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wareseek.operators.filters import Conditions
from wareseek.schemas import CATEGORIES, COLORS, SEASONS
from wareseek.sources.table import write_search_layout
from wareseek.storage import scratch_path, spread

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Standard parameters of the search queries.
TEXT = "red widget"
N = 20
THRESHOLD = 0.6
ALL_LABELS = Conditions(900, 990, 1.0, CATEGORIES, COLORS, SEASONS)
CONDITIONS = Conditions(900, 990, 1.0, CATEGORIES, COLORS, ("Summer", "Winter"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    by = lambda divisor, labels: F.element_at(
        F.array(*[F.lit(x) for x in labels]), (F.pmod(key, F.lit(divisor)) + 1).cast("int")
    )
    return table(spark, sf_dir, "part").select(
        key.alias("_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("http://img/a; http://img/"), key.cast("string"), F.lit(" ")).alias("img"),
        F.col("p_retailprice").alias("price"),
        F.when(key % 13 != 0, (F.col("p_size") % 21) / F.lit(4.0)).alias("rating"),
        by(5, CATEGORIES).alias("category"),
        F.when(key % 11 != 0, by(4, SEASONS)).alias("season"),
        F.when(F.col("p_name").contains("red"), "Red")
        .when(F.col("p_name").contains("blue"), "Blue")
        .alias("color"),
    )


def _in_turn(df: DataFrame, other: DataFrame, key: str, other_key: str, spare: int = 0) -> DataFrame:
    """Left join each product with the row of ``other`` whose turn it is."""
    size = other.agg(F.count(F.lit(1))).scalar()
    turn = F.col(key) % (size + F.lit(spare))
    return df.withColumn("_turn", turn).join(other, F.col("_turn") == F.col(other_key), "left").drop("_turn")


def with_vectors(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("description_embedding")
    )
    return _in_turn(df, vectors, "_id", "vec_id").drop("vec_id")


def with_texts(df: DataFrame, spark: SparkSession, sf_dir: str, key: str = "_id") -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
    return _in_turn(df, texts, key, "doc_id").drop("doc_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, ready for work that is costly per row."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


_STORED: dict[tuple[str, str], str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with vectors, stored once per session as searches expect to find them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        path = scratch_path(spark, "catalog")
        write_search_layout(with_vectors(products(spark, sf_dir), spark, sf_dir), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their whole descriptions."""
    return with_texts(spread(products(spark, sf_dir), "_id"), spark, sf_dir)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


PRODUCTS_SQL = """
products AS (
  SELECT p_partkey AS _id, p_name AS name,
         concat('http://img/a; http://img/', CAST(p_partkey AS VARCHAR), ' ') AS img,
         p_retailprice AS price,
         CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 21) / 4.0e0 END AS rating,
         CASE p_partkey % 5 WHEN 0 THEN 'Tops' WHEN 1 THEN 'Bottoms' WHEN 2 THEN 'Dresses'
                            WHEN 3 THEN 'Footwear' ELSE 'Accessories' END AS category,
         CASE WHEN p_partkey % 11 <> 0 THEN
           CASE p_partkey % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Winter'
                              WHEN 2 THEN 'Spring' ELSE 'Fall' END END AS season,
         CASE WHEN p_name LIKE '%red%' THEN 'Red' WHEN p_name LIKE '%blue%' THEN 'Blue' END AS color
  FROM part
)"""
CATALOG_SQL = (
    PRODUCTS_SQL
    + """,
catalog AS (
  SELECT products.*, embedding AS description_embedding
  FROM products LEFT JOIN embeddings ON vec_id = _id % (SELECT count(*) FROM embeddings)
)"""
)
DESCRIBED_SQL = (
    PRODUCTS_SQL
    + """,
described AS (
  SELECT products.*, text AS description
  FROM products LEFT JOIN documents ON doc_id = _id % (SELECT count(*) FROM documents)
)"""
)

_QUOTED = lambda labels: ", ".join(f"'{label}'" for label in labels)
BASE_WHERE = "price BETWEEN 900 AND 990 AND rating >= 1.0"
WHERE = (
    f"{BASE_WHERE} AND category IN ({_QUOTED(CATEGORIES)}) AND color IN ({_QUOTED(COLORS)}) "
    "AND season IN ('Summer', 'Winter')"
)


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def cosine_sql(vector: str, query: str = "(SELECT embedding FROM embeddings WHERE vec_id = 0)") -> str:
    return f"list_cosine_similarity(CAST({vector} AS DOUBLE[]), CAST({query} AS DOUBLE[]))"


def score_sql(vector: str, query: str = "(SELECT embedding FROM embeddings WHERE vec_id = 0)") -> str:
    return f"round((1 + {cosine_sql(vector, query)}) / 2, 9)"


# BM25 of names for the words of one text; relevance statistics cover every product.
def bm25_sql(text: str) -> str:
    return f"""
doc_tokens AS (SELECT _id, {tokens_sql('name')} AS toks FROM products),
doc_terms AS (
  SELECT _id, term, count(*) AS tf, any_value(len) AS len
  FROM (SELECT _id, unnest(toks) AS term, len(toks) AS len FROM doc_tokens) GROUP BY _id, term
),
corpus AS (SELECT count(*) AS docs, avg(len(toks)) AS mean_len FROM doc_tokens WHERE len(toks) > 0),
words AS (SELECT term, count(*) AS repeats FROM (SELECT unnest({tokens_sql(text)}) AS term) GROUP BY term),
freq AS (SELECT term, count(*) AS df FROM doc_terms GROUP BY term),
relevance AS (
  SELECT _id, round(sum(repeats * ln(1 + (docs - df + 0.5) / (df + 0.5e0))
                        * tf / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * len / mean_len))), 9) AS score
  FROM doc_terms JOIN words USING (term) JOIN freq USING (term) CROSS JOIN corpus GROUP BY _id
)"""


def conditions_column(strict: bool = True) -> Column:
    return CONDITIONS.strict() if strict else CONDITIONS.lenient()

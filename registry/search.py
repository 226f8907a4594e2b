"""Search queries: predicates, ranking, text, vectors, fusion and the complete searches."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from registry.base import (
    BASE_WHERE,
    CATALOG_SQL,
    CONDITIONS,
    N,
    PRODUCTS_SQL,
    TEXT,
    THRESHOLD,
    WHERE,
    bm25_sql,
    catalog,
    documents,
    products,
    query,
    query_vector,
    score_sql,
    table,
    with_vectors,
    tokens_sql,
)
from wareseek.operators import filters
from wareseek.operators.approximate import Planes, VectorIndex
from wareseek.operators.filters import Conditions
from wareseek.operators.lexical import build_postings, term_stats
from wareseek.operators.ranking import (
    collect_ranked,
    fuse,
    keep_first,
    merge_by_name,
    rank_score,
    top_n_per_query,
    union_ranked,
    with_rank,
)
from wareseek.operators.text_index import TextIndex
from wareseek.operators.vector import build_vectors, nearest, vector_search
from wareseek.plans import search
from wareseek.plans.search import SearchRequest
from wareseek.sources.versions import VersionedTable
from wareseek.storage import scratch_path

REQUEST = SearchRequest(TEXT, CONDITIONS, N, threshold=THRESHOLD)


# --- Predicates --------------------------------------------------------------------------------


@query("filter_price_range", f"WITH {PRODUCTS_SQL} SELECT _id, price FROM products WHERE price BETWEEN 910 AND 950")
def _(spark, sf):
    return products(spark, sf).filter(filters.price_between(910, 950)).select("_id", "price")


@query("filter_min_rating", f"WITH {PRODUCTS_SQL} SELECT _id, rating FROM products WHERE rating >= 4.0")
def _(spark, sf):
    return products(spark, sf).filter(filters.rating_at_least(4.0)).select("_id", "rating")


@query(
    "filter_facets_required",
    f"""WITH {PRODUCTS_SQL} SELECT _id, season, 'given' AS list FROM products
    WHERE season IN ('Summer', 'Winter')""",
)
def _(spark, sf):
    given = filters.facet_required("season", ["Summer", "Winter"])
    empty = filters.facet_required("season", [])
    rows = products(spark, sf).select("_id", "season")
    return rows.filter(given).withColumn("list", F.lit("given")).unionByName(
        rows.filter(empty).withColumn("list", F.lit("empty"))
    )


@query(
    "filter_facets_optional",
    f"""WITH {PRODUCTS_SQL} SELECT _id, season, 'given' AS list FROM products
    WHERE season IN ('Summer', 'Winter')
    UNION ALL SELECT _id, season, 'empty' AS list FROM products""",
)
def _(spark, sf):
    given = filters.facet_optional("season", ["Summer", "Winter"])
    empty = filters.facet_optional("season", [])
    rows = products(spark, sf).select("_id", "season")
    return rows.filter(given).withColumn("list", F.lit("given")).unionByName(
        rows.filter(empty).withColumn("list", F.lit("empty"))
    )


# --- Vector search -----------------------------------------------------------------------------

_NEAREST = f"""nearest AS (
  SELECT _id, img, name, score, row_number() OVER (ORDER BY score DESC, _id) - 1 AS rank
  FROM (SELECT *, {score_sql('description_embedding')} AS score FROM catalog
        WHERE {WHERE} AND description_embedding IS NOT NULL
        ORDER BY score DESC, _id LIMIT {N})
)"""


@query(
    "vector_search",
    f"WITH {CATALOG_SQL}, {_NEAREST} SELECT _id, img, name, score FROM nearest WHERE score >= {THRESHOLD}",
)
def _(spark, sf):
    return vector_search(
        catalog(spark, sf),
        query_vector(spark, sf),
        N,
        where=CONDITIONS.strict(),
        threshold=THRESHOLD,
    )


@query(
    "score_threshold",
    f"""SELECT * FROM (SELECT vec_id, {score_sql('embedding')} AS score FROM embeddings
    ORDER BY score DESC, vec_id LIMIT {N}) WHERE score >= 0.65""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    best = nearest(vectors, query_vector(spark, sf), N, "embedding", tie="vec_id")
    return best.filter(F.col("score") >= 0.65)


@query(
    "rank_rows",
    f"WITH {CATALOG_SQL}, {_NEAREST} SELECT _id, name, score, CAST(rank AS BIGINT) AS rank FROM nearest",
)
def _(spark, sf):
    rows = catalog(spark, sf)
    best = nearest(rows, query_vector(spark, sf), N, where=CONDITIONS.strict())
    return with_rank(best).select("_id", "name", "score", "rank")


@query(
    "rank_to_score",
    f"WITH {CATALOG_SQL}, {_NEAREST} SELECT _id, name, img, round(1.0e0 / (rank + 1 + 1), 12) AS vs_score FROM nearest",
)
def _(spark, sf):
    rows = catalog(spark, sf)
    best = with_rank(nearest(rows, query_vector(spark, sf), N, where=CONDITIONS.strict()))
    return best.select("_id", "name", "img", F.round(rank_score(1), 12).alias("vs_score"))


_UNIT = "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))"


@query(
    "build_vectors",
    f"""SELECT vec_id, CAST(generate_subscripts(unit, 1) - 1 AS INTEGER) AS position, unnest(unit) AS value FROM (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / norm AS FLOAT)) AS unit
      FROM (SELECT vec_id, embedding, {_UNIT} AS norm FROM embeddings) WHERE norm > 0)""",
)
def _(spark, sf):
    units = build_vectors(table(spark, sf, "embeddings"), 64, "embedding", "vec_id")
    return units.select("vec_id", F.posexplode("unit").alias("position", "value"))


@query(
    "vector_nearest",
    f"""WITH {CATALOG_SQL} SELECT _id, name, {score_sql('description_embedding')} AS score FROM catalog
    WHERE {BASE_WHERE} AND description_embedding IS NOT NULL ORDER BY score DESC, _id LIMIT {N}""",
)
def _(spark, sf):
    rows = catalog(spark, sf).select("_id", "name", "price", "rating", "description_embedding")
    where = Conditions(900, 990, 1.0).lenient()
    return nearest(rows, query_vector(spark, sf), N, where=where).select("_id", "name", "score")


# Few bits and many tables: the test vectors are nearly at right angles, so near ones hardly differ from others.
ANN_PLANES = Planes(dims=64, bits=5, tables=48)
_ANN_INDEX: dict[tuple[str, str], str] = {}


def vector_index(spark, sf) -> VectorIndex:
    """The bucket table of the catalog, stored once per session."""
    key = spark.sparkContext.applicationId, sf
    if key not in _ANN_INDEX:
        path = scratch_path(spark, "vector-index")
        VectorIndex.build(catalog(spark, sf), path, ANN_PLANES)
        _ANN_INDEX[key] = path
    return VectorIndex.load(spark, _ANN_INDEX[key])


def ann_queries(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )


def _planes_sql(planes: Planes) -> str:
    rows = planes.matrix().reshape(planes.tables, planes.bits, planes.dims).astype(int).tolist()
    values = (f"({t}, {b}, {plane})" for t, bits in enumerate(rows) for b, plane in enumerate(bits))
    return ", ".join(values)


@query(
    "ann_search",
    f"""WITH {CATALOG_SQL},
    planes(tbl, bit, plane) AS (VALUES {_planes_sql(ANN_PLANES)}),
    vectors AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    cells AS (
      SELECT vec_id, tbl, sum(CASE WHEN list_dot_product(v, CAST(plane AS DOUBLE[])) > 0 THEN 1 << bit ELSE 0 END) AS cell
      FROM vectors CROSS JOIN planes GROUP BY vec_id, tbl),
    pairs AS (
      SELECT DISTINCT q.vec_id AS query_id, c.vec_id FROM cells q JOIN cells c ON q.tbl = c.tbl AND q.cell = c.cell
      WHERE q.vec_id % 50 = 0),
    scored AS (
      SELECT query_id, catalog._id, catalog.name, round((1 + list_cosine_similarity(a.v, b.v)) / 2, 9) AS score
      FROM pairs JOIN vectors a ON a.vec_id = query_id JOIN vectors b ON b.vec_id = pairs.vec_id
           JOIN catalog ON catalog._id % (SELECT count(*) FROM embeddings) = pairs.vec_id)
    SELECT query_id, CAST(rank AS BIGINT) AS rank, _id, name, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, _id) - 1 AS rank FROM scored) WHERE rank < {N}""",
)
def _(spark, sf):
    hits = vector_index(spark, sf).nearest(catalog(spark, sf), ann_queries(spark, sf), N)
    return hits.select("query_id", "rank", "_id", "name", "score")


# --- Text search -------------------------------------------------------------------------------


@query(
    "build_postings",
    f"""SELECT p_partkey, term, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(length) AS INTEGER) AS length FROM (
      SELECT p_partkey, unnest(toks) AS term, len(toks) AS length
      FROM (SELECT p_partkey, {tokens_sql('p_name')} AS toks FROM part)) GROUP BY p_partkey, term""",
)
def _(spark, sf):
    return build_postings(table(spark, sf, "part"), "p_name", "p_partkey")


@query(
    "term_stats",
    f"""SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM (
      SELECT doc_id, term, count(*) AS tf
      FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY doc_id, term)
    GROUP BY term""",
)
def _(spark, sf):
    return term_stats(build_postings(documents(spark, sf), "text", "doc_id"))


_TEXT_HITS = f"""{bm25_sql(f"'{TEXT}'")},
hits AS (
  SELECT _id, img, name, score, row_number() OVER (ORDER BY score DESC, _id) - 1 AS rank
  FROM (SELECT products.*, score FROM relevance JOIN products USING (_id) WHERE {WHERE}
        ORDER BY score DESC, _id LIMIT {N})
)"""


@query("lexical_search", f"WITH {PRODUCTS_SQL}, {_TEXT_HITS} SELECT _id, img, name, score FROM hits")
def _(spark, sf):
    return search.lexical_search(products(spark, sf), TEXT, CONDITIONS, N)


_PRODUCTS = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("name", "img", "category", "season", "color")],
        *[T.StructField(c, T.DoubleType()) for c in ("price", "rating")],
    ]
)
_INDEXED: dict[tuple[str, str], str] = {}


def indexed_table(spark, sf) -> tuple[VersionedTable, TextIndex]:
    """Products that came with other names and were renamed by an update, and the index that followed."""
    key = spark.sparkContext.applicationId, sf
    path = _INDEXED.get(key) or scratch_path(spark, "indexed")
    items = VersionedTable(spark, f"{path}/table", _PRODUCTS, buckets=8)
    index = TextIndex(spark, f"{path}/index", key_type="long", buckets=8)
    if key not in _INDEXED:
        rows = products(spark, sf)
        items.replace(rows.withColumn("name", F.when(F.col("_id") % 3 == 0, F.col("name")).otherwise(F.concat("img", "name"))))
        index.follow(items)
        items.upsert(rows.select("_id", "name"))
        index.follow(items)
        _INDEXED[key] = path
    return items, index


@query("indexed_search", f"WITH {PRODUCTS_SQL}, {_TEXT_HITS} SELECT _id, img, name, score FROM hits")
def _(spark, sf):
    items, index = indexed_table(spark, sf)
    return search.lexical_search(items.read(), TEXT, CONDITIONS, N, index)


@query(
    "indexed_terms",
    f"""WITH {PRODUCTS_SQL} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM (
      SELECT _id, term, count(*) AS tf FROM (SELECT _id, unnest({tokens_sql('name')}) AS term FROM products) GROUP BY _id, term)
    GROUP BY term""",
)
def _(spark, sf):
    """The statistics that the index has arrived at by its updates."""
    return indexed_table(spark, sf)[1].index().terms.select("term", "df", "total_tf")


# --- Fusion ------------------------------------------------------------------------------------

# Every product twice: as a vector hit ranked by key, and as a text hit ranked the other way round.
_BAG = """bag AS (
  SELECT _id, name, img, 0 AS source, CAST(_id AS BIGINT) AS rank,
         1.0e0 / (_id + 2) AS vs_score, CAST(NULL AS DOUBLE) AS fts_score FROM products
  UNION ALL
  SELECT _id, name, img, 1 AS source, CAST(200000000 - _id AS BIGINT) AS rank,
         CAST(NULL AS DOUBLE) AS vs_score, 1.0e0 / (200000000 - _id + 11) AS fts_score FROM products
)"""


def bag(spark, sf):
    rows = products(spark, sf).select("_id", "name", "img")
    near = rows.withColumn("rank", F.col("_id").cast("long"))
    text = rows.withColumn("rank", (F.lit(200000000) - F.col("_id")).cast("long"))
    return union_ranked(
        near.withColumn("vs_score", rank_score(1)), text.withColumn("fts_score", rank_score(10))
    )


@query(
    "union_ranked",
    f"""WITH {PRODUCTS_SQL}, {_BAG} SELECT _id, name, img, source, rank, round(vs_score, 12) AS vs_score,
    round(fts_score, 12) AS fts_score FROM bag""",
)
def _(spark, sf):
    rows = bag(spark, sf)
    return rows.withColumns({c: F.round(c, 12) for c in ("vs_score", "fts_score")})


@query(
    "group_merge",
    f"""WITH {PRODUCTS_SQL}, {_BAG} SELECT name, arg_min(img, source * 1000000000 + rank) AS img,
    round(max(vs_score), 12) AS vs_score, round(max(fts_score), 12) AS fts_score FROM bag GROUP BY name""",
)
def _(spark, sf):
    rows = merge_by_name(bag(spark, sf))
    return rows.withColumns({c: F.round(c, 12) for c in ("vs_score", "fts_score")})


@query(
    "rank_fusion",
    f"""WITH {PRODUCTS_SQL}, {_BAG}, merged AS (
      SELECT name, arg_min(img, source * 1000000000 + rank) AS img,
             round(coalesce(max(fts_score), 0) + coalesce(max(vs_score), 0), 12) AS score
      FROM bag GROUP BY name)
    SELECT name, img, score, CAST(row_number() OVER (ORDER BY score DESC, name) - 1 AS BIGINT) AS rank
    FROM merged ORDER BY score DESC, name LIMIT {N}""",
)
def _(spark, sf):
    return fuse(bag(spark, sf), N).select("name", "img", "score", "rank")


_FUSED = """fused AS (
  SELECT name, arg_min(img, source * 1000000000 + rank) AS img,
         coalesce(max(vs_score), 0) AS vs_score, coalesce(max(fts_score), 0) AS fts_score,
         round(coalesce(max(fts_score), 0) + coalesce(max(vs_score), 0), 12) AS score
  FROM (
    SELECT name, img, 0 AS source, rank, 1.0e0 / (rank + 2) AS vs_score, NULL::DOUBLE AS fts_score
    FROM nearest WHERE score >= {threshold}
    UNION ALL
    SELECT name, img, 1 AS source, rank, NULL::DOUBLE, 1.0e0 / (rank + 11) FROM hits)
  GROUP BY name
)"""
_HYBRID = f"WITH {CATALOG_SQL}, {_NEAREST}, {_TEXT_HITS}, {_FUSED.format(threshold=THRESHOLD)}"


@query(
    "hybrid_search",
    f"""{_HYBRID} SELECT name, img, round(vs_score, 12) AS vs_score, round(fts_score, 12) AS fts_score, score,
    CAST(row_number() OVER (ORDER BY score DESC, name) - 1 AS BIGINT) AS rank
    FROM fused ORDER BY score DESC, name LIMIT {N}""",
)
def hybrid(spark, sf):
    hits = search.hybrid_search(catalog(spark, sf), REQUEST, query_vector(spark, sf))
    return hits.withColumns({c: F.round(c, 12) for c in ("vs_score", "fts_score")})


# One query per product name; its vector is that of the first product of that name.
_QUERIES = """queries AS (
  SELECT qid AS query_id, text, embedding AS vector
  FROM (SELECT min(p_partkey) AS qid, p_name AS text FROM part GROUP BY p_name)
  LEFT JOIN embeddings ON vec_id = qid % (SELECT count(*) FROM embeddings)
)"""


def query_table(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("_id"))
    names = names.withColumnRenamed("p_name", "text")
    return with_vectors(names, spark, sf).select(
        F.col("_id").alias("query_id"), "text", F.col("description_embedding").alias("vector")
    )


def batch_sql(queries: str, near_where: str, text_where: str, n: str) -> str:
    return f"""WITH {CATALOG_SQL}, {queries},
    near AS (
      SELECT * FROM (
        SELECT query_id, n, name, img, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, _id) - 1 AS rank
        FROM (SELECT query_id, {n} AS n, _id, name, img, {score_sql('description_embedding', 'vector')} AS score
              FROM catalog CROSS JOIN queries WHERE {near_where} AND description_embedding IS NOT NULL))
      WHERE rank < n AND score >= {THRESHOLD}
    ),
    doc_tokens AS (SELECT _id, {tokens_sql('name')} AS toks FROM products),
    doc_terms AS (
      SELECT _id, term, count(*) AS tf, any_value(len) AS len
      FROM (SELECT _id, unnest(toks) AS term, len(toks) AS len FROM doc_tokens) GROUP BY _id, term),
    corpus AS (SELECT count(*) AS docs, avg(len(toks)) AS mean_len FROM doc_tokens WHERE len(toks) > 0),
    words AS (
      SELECT query_id, term, count(*) AS repeats
      FROM (SELECT query_id, unnest({tokens_sql('text')}) AS term FROM queries) GROUP BY query_id, term),
    freq AS (SELECT term, count(*) AS df FROM doc_terms GROUP BY term),
    relevance AS (
      SELECT query_id, _id, round(sum(repeats * ln(1 + (docs - df + 0.5) / (df + 0.5e0))
                   * tf / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * len / mean_len))), 9) AS score
      FROM doc_terms JOIN words USING (term) JOIN freq USING (term) CROSS JOIN corpus GROUP BY query_id, _id),
    hits AS (
      SELECT * FROM (
        SELECT query_id, {n} AS n, name, img, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, _id) - 1 AS rank
        FROM relevance JOIN products USING (_id) JOIN queries USING (query_id) WHERE {text_where})
      WHERE rank < n),
    fused AS (
      SELECT query_id, name, arg_min(img, source * 1000000000 + rank) AS img, any_value(n) AS n,
             round(coalesce(max(fts_score), 0) + coalesce(max(vs_score), 0), 12) AS score
      FROM (
        SELECT query_id, n, name, img, 0 AS source, rank, 1.0e0 / (rank + 2) AS vs_score, NULL::DOUBLE AS fts_score FROM near
        UNION ALL
        SELECT query_id, n, name, img, 1 AS source, rank, NULL::DOUBLE, 1.0e0 / (rank + 11) FROM hits)
      GROUP BY query_id, name),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) - 1 AS rank FROM fused)
    SELECT query_id, CAST(rank AS BIGINT) AS rank, name, img, score FROM placed WHERE rank < n"""


@query("batch_hybrid_search", batch_sql(_QUERIES, WHERE, WHERE, str(N)))
def batch_hybrid(spark, sf):
    hits = search.batch_hybrid_search(catalog(spark, sf), query_table(spark, sf), REQUEST)
    return hits.select("query_id", "rank", "name", "img", "score")


# The same queries, each with conditions and a number of results of its own.
_REQUESTS = """base AS (
  SELECT qid AS query_id, text, embedding AS vector
  FROM (SELECT min(p_partkey) AS qid, p_name AS text FROM part GROUP BY p_name)
  LEFT JOIN embeddings ON vec_id = qid % (SELECT count(*) FROM embeddings)
),
queries AS (
  SELECT *, CAST(query_id % 16 + 5 AS INTEGER) AS want, 900.0e0 AS min_price, query_id % 80 + 920.0e0 AS max_price,
         query_id % 5 / 2.0e0 AS min_rating, ['Tops', 'Dresses', 'Footwear'] AS categories,
         CASE WHEN query_id % 4 = 0 THEN ['Red'] ELSE ['Red', 'Blue'] END AS colors,
         CASE WHEN query_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['Summer', 'Winter'] END AS seasons FROM base
)"""
_OWN = "price BETWEEN min_price AND max_price AND rating >= min_rating"
_STRICT = f"{_OWN} AND list_contains(categories, category) AND list_contains(colors, color) AND list_contains(seasons, season)"
_LENIENT = (
    f"{_OWN} AND list_contains(categories, category) AND list_contains(colors, color) "
    "AND (len(seasons) = 0 OR list_contains(seasons, season))"
)


def request_table(spark, sf):
    key = F.col("query_id")
    labels = lambda *values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return query_table(spark, sf).select(
        "*",
        (key % 16 + 5).cast("int").alias("n"),
        F.lit(900.0).alias("min_price"),
        (key % 80 + F.lit(920.0)).alias("max_price"),
        (key % 5 / F.lit(2.0)).alias("min_rating"),
        labels("Tops", "Dresses", "Footwear").alias("categories"),
        F.when(key % 4 == 0, labels("Red")).otherwise(labels("Red", "Blue")).alias("colors"),
        F.when(key % 3 == 0, labels()).otherwise(labels("Summer", "Winter")).alias("seasons"),
    )


@query("batch_requests", batch_sql(_REQUESTS, _STRICT, _LENIENT, "want"))
def _(spark, sf):
    hits = search.batch_hybrid_search(catalog(spark, sf), request_table(spark, sf), REQUEST)
    return hits.select("query_id", "rank", "name", "img", "score")


# The same requests, some with a blank text, the others asking for one kind of search or both.
_DISPATCHED = (
    _REQUESTS.replace("queries AS (", "stated AS (")
    + """,
queries AS (
  SELECT * REPLACE (CASE WHEN query_id % 7 = 0 THEN ' ' ELSE text END AS text),
         CASE WHEN query_id % 7 = 0 THEN 'browse' WHEN query_id % 5 = 0 THEN 'vector' WHEN query_id % 5 = 1 THEN 'lexical'
              ELSE 'hybrid' END AS kind FROM stated
)"""
)
_IMAGE = "trim(string_split(img, ';')[-1])"
_DISPATCH = f"""SELECT query_id, CAST(rank AS BIGINT) AS rank, {_IMAGE} AS image, name FROM (
      SELECT query_id, rank, img, name FROM placed JOIN queries USING (query_id) WHERE kind = 'hybrid' AND rank < want
      UNION ALL SELECT query_id, rank, img, name FROM near JOIN queries USING (query_id) WHERE kind = 'vector'
      UNION ALL SELECT query_id, rank, img, name FROM hits JOIN queries USING (query_id) WHERE kind = 'lexical'
      UNION ALL SELECT query_id, rank, img, name FROM (
        SELECT query_id, want, img, name, row_number() OVER (PARTITION BY query_id ORDER BY rating DESC, _id) - 1 AS rank
        FROM products CROSS JOIN queries WHERE kind = 'browse' AND rating IS NOT NULL AND {_LENIENT}) WHERE rank < want)"""
_FINAL = "SELECT query_id, CAST(rank AS BIGINT) AS rank, name, img, score FROM placed WHERE rank < n"


@query("batch_ai_search", batch_sql(_DISPATCHED, _STRICT, _LENIENT, "want").replace(_FINAL, _DISPATCH))
def _(spark, sf):
    key = F.col("query_id")
    types = F.when(key % 5 == 0, F.array(F.lit("Vector"))).when(key % 5 == 1, F.array(F.lit("LEXICAL")))
    requests = request_table(spark, sf).withColumns(
        {"text": F.when(key % 7 == 0, F.lit(" ")).otherwise(F.col("text")), "search_types": types}
    )
    return search.batch_ai_search(catalog(spark, sf), requests, REQUEST)


# --- Complete searches -------------------------------------------------------------------------


@query(
    "browse",
    f"""WITH {PRODUCTS_SQL} SELECT _id, img, name, price, rating FROM products WHERE {WHERE}
    ORDER BY rating DESC, _id LIMIT {N}""",
)
def _(spark, sf):
    return search.browse(products(spark, sf), CONDITIONS, N)


@query(
    "legacy_search",
    f"""WITH {PRODUCTS_SQL}, {bm25_sql(f"'{TEXT}'")},
    texted AS (SELECT _id, img, name, score FROM relevance JOIN products USING (_id) WHERE {BASE_WHERE}
               ORDER BY score DESC, _id LIMIT {N}),
    browsed AS (SELECT _id, img, name, rating AS score FROM products WHERE {BASE_WHERE}
                ORDER BY rating DESC, _id LIMIT {N})
    SELECT 'text' AS request, CAST(row_number() OVER (ORDER BY score DESC, _id) - 1 AS BIGINT) AS rank,
           {_IMAGE} AS image, name FROM texted
    UNION ALL
    SELECT 'blank', CAST(row_number() OVER (ORDER BY score DESC, _id) - 1 AS BIGINT), {_IMAGE}, name FROM browsed""",
)
def _(spark, sf):
    run = lambda text: search.legacy_search(products(spark, sf), text, CONDITIONS, N)
    return (
        run(TEXT)
        .select(F.lit("text").alias("request"), "*")
        .unionByName(run("  ").select(F.lit("blank").alias("request"), "*"))
    )


@query(
    "ai_search",
    f"""WITH {CATALOG_SQL}, {_NEAREST}, {_TEXT_HITS}, {_FUSED.format(threshold=0.92)},
    both_kinds AS (SELECT row_number() OVER (ORDER BY score DESC, name) - 1 AS rank, img, name
              FROM fused ORDER BY score DESC, name LIMIT {N}),
    browsed AS (SELECT row_number() OVER (ORDER BY rating DESC, _id) - 1 AS rank, img, name
                FROM products WHERE {WHERE} ORDER BY rating DESC, _id LIMIT {N})
    SELECT 'hybrid' AS request, CAST(rank AS BIGINT) AS rank, {_IMAGE} AS image, name FROM both_kinds
    UNION ALL SELECT 'vector', CAST(rank AS BIGINT), {_IMAGE}, name FROM nearest WHERE score >= 0.92
    UNION ALL SELECT 'lexical', CAST(rank AS BIGINT), {_IMAGE}, name FROM hits
    UNION ALL SELECT 'blank', CAST(rank AS BIGINT), {_IMAGE}, name FROM browsed""",
)
def _(spark, sf):
    rows = catalog(spark, sf)
    vector = query_vector(spark, sf)
    requests = {
        "hybrid": SearchRequest(TEXT, CONDITIONS, N),
        "vector": SearchRequest(TEXT, CONDITIONS, N, ["Vector"]),
        "lexical": SearchRequest(TEXT, CONDITIONS, N, ["Lexical"]),
        "blank": SearchRequest(" ", CONDITIONS, N),
    }
    results = [
        search.ai_search(rows, request, lambda _text: vector).select(F.lit(name).alias("request"), "*")
        for name, request in requests.items()
    ]
    first, *rest = results
    for result in rest:
        first = first.unionByName(result)
    return first


@query(
    "format_results",
    f"WITH {CATALOG_SQL}, {_NEAREST} SELECT CAST(rank AS BIGINT) AS rank, {_IMAGE} AS image, name FROM nearest",
)
def _(spark, sf):
    best = nearest(catalog(spark, sf), query_vector(spark, sf), N, where=CONDITIONS.strict())
    return search.format_results(best)


@query(
    "collect_ranked",
    f"""WITH {PRODUCTS_SQL}, placed AS (
      SELECT category, _id, row_number() OVER (PARTITION BY category ORDER BY rating DESC, _id) - 1 AS rank
      FROM products WHERE {BASE_WHERE})
    SELECT category, CAST(count(*) AS INTEGER) AS docs, string_agg(CAST(_id AS VARCHAR), ',' ORDER BY rank) AS ids
    FROM placed WHERE rank < {N} GROUP BY category""",
)
def _(spark, sf):
    rows = products(spark, sf).filter(Conditions(900, 990, 1.0).lenient())
    best = top_n_per_query(rows.select("category", "_id", "rating"), N, "category", "rating")
    lists = collect_ranked(best.select("category", "rank", "_id"), "category")
    ids = F.array_join(F.transform("docs", lambda d: d["_id"].cast("string")), ",")
    return lists.select("category", F.size("docs").alias("docs"), ids.alias("ids"))


@query(
    "dedup_keep_first",
    f"""WITH {PRODUCTS_SQL} SELECT name, _id, img, price FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY _id) AS place FROM products) WHERE place = 1""",
)
def _(spark, sf):
    rows = products(spark, sf).select("name", "_id", "img", "price")
    return keep_first(rows, ["name"], ["_id"])

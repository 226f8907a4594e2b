"""Enrichment queries: sources, text columns, models, the product table and complete runs.

Models, fetchers and remote clients are small deterministic functions here, so that the SQL can
state what they return.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F, types as T

from registry.base import DESCRIBED_SQL, PRODUCTS_SQL, described, documents, products, query, table, tokens_sql
from wareseek.functions.geometry import center_square
from wareseek.functions.text import (
    DESCRIPTION_PROMPT,
    LABEL_PROMPTS,
    clean_label,
    primary_image,
    token_count,
    tokens,
)
from wareseek.functions.vectors import hashed_embedding
from wareseek.operators.filters import drop_incomplete
from wareseek.operators.inference import classify, describe, embed_columns, infer, with_retries
from wareseek.plans import enrich
from wareseek.plans.enrich import OfflineModels
from wareseek.schemas import COLORS, FACETS, LABEL_OUTPUT_BUFFER_TOKENS, RAW_CATALOG, SEASONS
from wareseek.sources.assets import fetch_assets, has_asset, join_assets
from wareseek.sources.csv import read_catalog_csv, read_catalog_csv_split, write_catalog_csv
from wareseek.sources.sink import JsonFolder, register_sink, send
from wareseek.sources.table import CatalogTable, write_batches
from wareseek.sources.versions import VersionedTable
from wareseek.storage import scratch_path
from wareseek.streaming.updates import start_updates

DIMS = 64

# --- Raw products -------------------------------------------------------------------------------


def raw_products(spark, sf, shift: int = 0, markup: float = 1.0):
    """Raw rows in the input shape, one per part; pictures are the pages, and a few are missing.

    ``shift`` moves the number in the name, so that a second delivery overlaps with the first.
    """
    key = F.col("p_partkey")
    pages = table(spark, sf, "pages")
    turn = key % (pages.agg(F.count(F.lit(1))).scalar() + 5)
    urls = pages.groupBy("page_id").agg(F.min("url").alias("page_url"))
    parts = table(spark, sf, "part").withColumn("_turn", turn)
    parts = parts.join(urls, F.col("_turn") == F.col("page_id"), "left")
    picture = F.coalesce("page_url", F.lit("http://nowhere/none"))
    return parts.select(
        key.alias("id"),
        F.concat_ws(" ", "p_name", (key + shift).cast("string")).alias("name"),
        F.concat(F.lit("http://img/a; "), picture, F.lit(" ")).alias("img"),
        F.col("p_brand").alias("asin"),
        (F.col("p_retailprice") * markup).alias("price"),
        (F.col("p_retailprice") + 100).alias("mrp"),
        F.when(key % 13 != 0, (F.col("p_size") % 21) / F.lit(4.0)).alias("rating"),
        (F.col("p_size") * 3).cast("long").alias("ratingTotal"),
        (F.col("p_size") % 7).cast("long").alias("discount"),
        F.col("p_type").alias("seller"),
        F.concat(F.lit("http://shop/"), key.cast("string")).alias("purl"),
    )


def raw_sql(name: str, shift: int = 0, markup: float = 1.0) -> str:
    return f"""
{name} AS (
  SELECT p_partkey AS id, concat(p_name, ' ', CAST(p_partkey + {shift} AS VARCHAR)) AS name,
         concat('http://img/a; ', coalesce(page_url, 'http://nowhere/none'), ' ') AS img,
         p_brand AS asin, p_retailprice * {markup}e0 AS price, p_retailprice + 100 AS mrp,
         CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 21) / 4.0e0 END AS rating,
         CAST(p_size * 3 AS BIGINT) AS ratingTotal, CAST(p_size % 7 AS BIGINT) AS discount,
         p_type AS seller, concat('http://shop/', CAST(p_partkey AS VARCHAR)) AS purl,
         coalesce(page_url, 'http://nowhere/none') AS url
  FROM part LEFT JOIN (SELECT page_id, min(url) AS page_url FROM pages GROUP BY page_id)
    ON page_id = p_partkey % ((SELECT count(*) FROM pages) + 5)
)"""


# Stored pictures: one per address.
_ASSETS = "assets AS (SELECT url, encode(min(html)) AS img FROM pages GROUP BY url)"


def stored_assets(spark, sf):
    pages = table(spark, sf, "pages").groupBy("url").agg(F.min("html").alias("html"))
    return pages.select("url", F.encode("html", "UTF-8").alias("img"))


def csv_with_documents(spark, sf) -> str:
    """Whole documents stand in the seller column: line breaks, quotes and commas must survive."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    raw = raw_products(spark, sf).join(texts, F.col("id") == F.col("doc_id"), "left")
    raw = raw.withColumn("seller", F.coalesce("text", F.lit(""))).select(*RAW_CATALOG.fieldNames())
    path = scratch_path(spark, "csv")
    write_catalog_csv(raw, path)
    return path


_CSV_SQL = f"""WITH {raw_sql('raw')} SELECT id, name, img, asin, price, mrp, rating, "ratingTotal", discount,
    coalesce(text, '') AS seller, purl FROM raw LEFT JOIN documents ON doc_id = id"""


@query("read_catalog_csv", _CSV_SQL)
def _(spark, sf):
    return read_catalog_csv(spark, csv_with_documents(spark, sf))


@query("read_catalog_csv_split", _CSV_SQL)
def _(spark, sf):
    return read_catalog_csv_split(spark, csv_with_documents(spark, sf))


def fetch_stub(url: str) -> bytes:
    if url.endswith("7"):
        raise OSError("unreachable")
    return f"picture of {url}".encode()


@query(
    "fetch_assets",
    f"""WITH {raw_sql('raw')} SELECT id, url, CAST(octet_length(encode(concat('picture of ', url))) AS INTEGER) AS bytes
    FROM raw WHERE NOT url LIKE '%7'""",
)
def _(spark, sf):
    raw = raw_products(spark, sf).select("id", primary_image(F.col("img")).alias("url"))
    fetched = fetch_assets(raw, fetch_stub).filter(has_asset())
    return fetched.select("id", "url", F.length("img").alias("bytes"))


@query(
    "join_assets",
    f"""WITH {raw_sql('raw')}, {_ASSETS} SELECT id, raw.url AS url, CAST(coalesce(octet_length(assets.img), 0) AS INTEGER) AS bytes
    FROM raw LEFT JOIN assets ON raw.url = assets.url""",
)
def _(spark, sf):
    raw = raw_products(spark, sf).select("id", primary_image(F.col("img")).alias("url"))
    return join_assets(raw, stored_assets(spark, sf)).select("id", "url", F.length("img").alias("bytes"))


# --- Columns ------------------------------------------------------------------------------------


@query(
    "primary_image",
    f"WITH {PRODUCTS_SQL} SELECT _id, trim(string_split(img, ';')[-1]) AS image FROM products",
)
def _(spark, sf):
    return products(spark, sf).select("_id", primary_image(F.col("img")).alias("image"))


@query(
    "tokenize",
    f"""SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
    FROM (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents)""",
)
def _(spark, sf):
    found = documents(spark, sf).select("doc_id", tokens(F.col("text")).alias("toks"))
    return found.select(
        "doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens")
    )


@query(
    "count_tokens",
    f"SELECT conv_id, turn, CAST(len({tokens_sql('text')}) AS INTEGER) AS num_tokens FROM conversations",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", token_count(tokens(F.col("text"))).alias("num_tokens"))


def _described_as(title: str) -> str:
    return f"""repeat('<image>', 1176) || chr(10) || 'USER: Write a product description for a shop page. The product is called: '
    || {title} || '. Mention the color seen in the picture.' || chr(10) || 'ASSISTANT:'"""


def _asked(facet: str, labels: str) -> str:
    return f"""'Product title: ' || name || chr(10) || 'Product description: ' || description || chr(10)
    || 'Which {facet} fits the product best? Answer with one of these words only: {labels}.'"""


# The prompts and answer lengths that the queries must arrive at, written out.
DESCRIPTION_SQL = _described_as("name")
LABEL_PROMPTS_SQL = {
    "category": _asked("category", "Tops, Bottoms, Dresses, Footwear, Accessories"),
    "season": _asked("season", "Summer, Winter, Spring, Fall"),
    "color": _asked("color", "Red, Blue, Green, Yellow, Black, White, Pink, Purple, Orange, Brown, Grey"),
}
ANSWER_TOKENS = {"description": 256, "category": 41, "season": 41, "color": 41}


@query(
    "description_prompt",
    f"""WITH {PRODUCTS_SQL} SELECT _id, CAST(length(prompt) AS INTEGER) AS length, md5(prompt) AS digest
    FROM (SELECT _id, {DESCRIPTION_SQL} AS prompt FROM products)""",
)
def _(spark, sf):
    prompts = products(spark, sf).select("_id", DESCRIPTION_PROMPT.text().alias("prompt"))
    return prompts.select("_id", F.length("prompt").alias("length"), F.md5("prompt").alias("digest"))


@query(
    "classifier_prompts",
    f"""WITH {DESCRIBED_SQL}
    SELECT _id, {', '.join(f'md5({p}) AS {facet}_prompt' for facet, p in LABEL_PROMPTS_SQL.items())}
    FROM described""",
)
def _(spark, sf):
    prompts = {f"{facet}_prompt": F.md5(p.text()) for facet, p in LABEL_PROMPTS.items()}
    return described(spark, sf).withColumns(prompts).select("_id", *prompts)


def label_sql(response: str, labels) -> str:
    hits = " + ".join(f"CAST(contains(lower({response}), '{x.lower()}') AS INTEGER)" for x in labels)
    named = " ".join(f"WHEN contains(lower({response}), '{x.lower()}') THEN '{x}'" for x in labels)
    return f"CASE WHEN {hits} = 1 THEN CASE {named} END END"


@query(
    "clean_label",
    f"""SELECT 'part' AS source, p_partkey AS id, {label_sql("concat('The color is ', p_name, '.')", COLORS)} AS color,
    {label_sql("concat('The color is ', p_name, '.')", SEASONS)} AS season FROM part
    UNION ALL SELECT 'document', doc_id, {label_sql('text', COLORS)}, {label_sql('text', SEASONS)} FROM documents""",
)
def _(spark, sf):
    named = F.concat(F.lit("The color is "), "p_name", F.lit("."))
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("id"), named.alias("response")
    )
    texts = documents(spark, sf).select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("response")
    )
    response = F.col("response")
    return parts.unionByName(texts).select(
        "source",
        "id",
        clean_label(response, COLORS).alias("color"),
        clean_label(response, SEASONS).alias("season"),
    )


@query(
    "center_square",
    f"""WITH sides AS (SELECT p_partkey, CAST(p_size * 20 + 100 AS BIGINT) AS w,
                      CAST(floor(p_retailprice) AS BIGINT) % 701 + 60 AS h FROM part),
    scaled AS (SELECT p_partkey, CASE WHEN w <= h THEN 336 ELSE (336 * w) // h END AS rw,
                      CASE WHEN w <= h THEN (336 * h) // w ELSE 336 END AS rh FROM sides)
    SELECT p_partkey, CAST(rw AS BIGINT) AS width, CAST(rh AS BIGINT) AS height,
           CAST((rw - 336) // 2 AS BIGINT) AS "left", CAST((rh - 336) // 2 AS BIGINT) AS top FROM scaled""",
)
def _(spark, sf):
    width = F.col("p_size") * 20 + 100
    height = F.floor("p_retailprice") % 701 + 60
    square = center_square(width, height)
    return table(spark, sf, "part").select("p_partkey", square.alias("s")).select("p_partkey", "s.*")


def embedding_sql(name: str, source: str, key: str, text: str, dims: int = DIMS) -> str:
    """CTE of ``(key, bucket, weight)`` for the built-in embedder."""
    return f"""
{name}_counts AS (
  SELECT {key}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {dims} AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest({tokens_sql(text)}) AS tok FROM {source}) GROUP BY ALL
),
{name} AS (
  SELECT {key}, CAST(bucket AS INTEGER) AS bucket,
         CAST(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) AS weight
  FROM {name}_counts
)"""


@query(
    "embed_text",
    f"WITH {embedding_sql('embedded', 'documents', 'doc_id', 'text')} SELECT doc_id, bucket, weight FROM embedded",
)
def _(spark, sf):
    vectors = documents(spark, sf).select("doc_id", hashed_embedding(F.col("text"), DIMS).alias("v"))
    return vectors.select("doc_id", F.posexplode_outer("v").alias("bucket", "weight")).filter("weight <> 0")


# --- Token budgets ------------------------------------------------------------------------------


def budget_sql() -> str:
    prompts = {"description": DESCRIPTION_SQL, **LABEL_PROMPTS_SQL}
    rows = [
        f"""SELECT '{stage}' AS stage, CAST(max(len({tokens_sql(prompt)})) AS BIGINT) AS max_input,
        CAST({ANSWER_TOKENS[stage]} AS BIGINT) AS max_output FROM described"""
        for stage, prompt in prompts.items()
    ]
    return f"WITH {DESCRIBED_SQL} SELECT *, max_input + max_output AS max_total FROM ({' UNION ALL '.join(rows)})"


@query("token_budget", budget_sql())
def _(spark, sf):
    return enrich.token_budgets(described(spark, sf))


@query(
    "max_prompt_tokens",
    f"""WITH {PRODUCTS_SQL} SELECT CAST(max(len({tokens_sql(DESCRIPTION_SQL)})) AS BIGINT) AS num_tokens
    FROM products""",
)
def _(spark, sf):
    budget = enrich.token_budgets(products(spark, sf), ["description"])
    return budget.select(F.col("max_input").alias("num_tokens"))


@query(
    "label_budget",
    f"""SELECT facet, label AS longest, CAST(len({tokens_sql('label')}) + 40 AS BIGINT) AS max_output FROM (
      SELECT facet, label, row_number() OVER (PARTITION BY facet ORDER BY length(label) DESC, place) AS r FROM (
        SELECT 'type' AS facet, p_type AS label, min(p_partkey) AS place FROM part GROUP BY p_type
        UNION ALL SELECT 'brand', p_brand, min(p_partkey) FROM part GROUP BY p_brand
        UNION ALL SELECT 'name', p_name, min(p_partkey) FROM part GROUP BY p_name)) WHERE r = 1""",
)
def _(spark, sf):
    """Vocabularies as they stand in the data, in order of first appearance."""
    facets = F.explode(
        F.array(
            *[
                F.struct(F.lit(facet).alias("facet"), F.col(column).alias("label"))
                for facet, column in (("type", "p_type"), ("brand", "p_brand"), ("name", "p_name"))
            ]
        )
    )
    labels = table(spark, sf, "part").select("p_partkey", facets.alias("f"))
    labels = labels.groupBy("f.facet", "f.label").agg(F.min("p_partkey").alias("place"))
    longest = labels.groupBy("facet").agg(
        F.max_by("label", F.struct(F.length("label"), -F.col("place"))).alias("longest")
    )
    allowance = F.size(tokens(F.col("longest"))) + LABEL_OUTPUT_BUFFER_TOKENS
    return longest.withColumn("max_output", allowance.cast("long"))


# --- Models -------------------------------------------------------------------------------------


def make_counter():
    return lambda batch: {
        "chars": [len(text) for text in batch["text"]],
        "shout": [text[:1].upper() + "!" for text in batch["text"]],
    }


@query(
    "batch_infer",
    """SELECT item_id, CAST(length(text) AS INTEGER) AS chars, concat(upper(substr(text, 1, 1)), '!') AS shout
    FROM benchmark""",
)
def _(spark, sf):
    items = table(spark, sf, "benchmark")
    return infer(items, make_counter, "chars int, shout string").select("item_id", "chars", "shout")


def make_flaky():
    """A service that refuses each name as many times as its length says, modulo 8."""
    calls = Counter()

    def call(name):
        calls[name] += 1
        if calls[name] <= len(name) % 8:
            raise ConnectionError
        calls[name] = 0
        return name.upper()

    def answer(name):
        calls[name] = 0
        return with_retries(call)(name)

    return lambda batch: {"answer": [answer(name) for name in batch["name"]]}


@query(
    "retry_infer",
    f"""WITH {PRODUCTS_SQL} SELECT _id, CASE WHEN length(name) % 8 < 6 THEN upper(name) END AS answer FROM products""",
)
def _(spark, sf):
    rows = products(spark, sf).select("_id", "name")
    return infer(rows, make_flaky, "answer string", drop=("name",))


def make_describer(_budget=None):
    def model(batch):
        return {"description": [f"{n} in {len(i)} bytes" for n, i in zip(batch["name"], batch["img"])]}

    return lambda: model


def category_answer(name: str) -> str:
    return "Footwear, I think" if len(name) % 2 else "tops or dresses"


def season_answer(text: str) -> str:
    return f"it is {SEASONS[len(text) % 4]}"


def color_answer(name: str) -> str:
    return f"the color is {name}"


def make_classifier(_budgets=None):
    def model(batch):
        return {
            "category_response": [category_answer(n) for n in batch["name"]],
            "season_response": [season_answer(d) for d in batch["description"]],
            "color_response": [color_answer(n) for n in batch["name"]],
        }

    return lambda: model


LABELS_SQL = f"""CASE WHEN length(name) % 2 = 1 THEN 'Footwear' END AS category,
  CASE length(description) % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' ELSE 'Fall' END AS season,
  {label_sql("concat('the color is ', name)", COLORS)} AS color"""


@query(
    "describe_items",
    f"""WITH {raw_sql('raw')}, {_ASSETS} SELECT id, name, concat(name, ' in ', CAST(octet_length(assets.img) AS VARCHAR), ' bytes') AS description
    FROM raw JOIN assets ON raw.url = assets.url WHERE octet_length(assets.img) > 0""",
)
def _(spark, sf):
    raw = raw_products(spark, sf).select("id", "name", primary_image(F.col("img")).alias("url"))
    pictured = join_assets(raw, stored_assets(spark, sf)).filter(has_asset())
    prompted = pictured.withColumn("description_prompt", DESCRIPTION_PROMPT.text())
    return describe(prompted, make_describer()).select("id", "name", "description")


@query(
    "classify_items",
    f"WITH {DESCRIBED_SQL}, rows AS (SELECT _id, name, description FROM described) SELECT _id, {LABELS_SQL} FROM rows",
)
def _(spark, sf):
    rows = described(spark, sf).select("_id", "name", "description")
    return classify(rows, make_classifier()).select("_id", "category", "season", "color")


# --- Records ------------------------------------------------------------------------------------


@query(
    "project_record",
    f"""WITH {DESCRIBED_SQL} SELECT CAST(_id AS VARCHAR) AS _id, name, img, price, rating, md5(description) AS digest,
    category, season, color, CAST(NULL AS BIGINT) AS dims FROM described""",
)
def _(spark, sf):
    none = F.lit(None).cast("array<float>")
    rows = described(spark, sf).withColumns({"name_embedding": none, "description_embedding": none})
    record = enrich.project_record(rows, "_id")
    return record.select(
        "_id", "name", "img", "price", "rating", F.md5("description").alias("digest"), "category",
        "season", "color", F.when(F.col("name_embedding").isNotNull(), F.size("name_embedding")).cast("long").alias("dims"),
    )


@query(
    "drop_incomplete",
    f"""WITH {PRODUCTS_SQL} SELECT _id, name, rating, season, color FROM products
    WHERE rating IS NOT NULL AND season IS NOT NULL AND color IS NOT NULL""",
)
def _(spark, sf):
    return drop_incomplete(products(spark, sf).select("_id", "name", "rating", "season", "color"))


@query("sink_batches", f"WITH {PRODUCTS_SQL} SELECT _id, name, price FROM products")
def _(spark, sf):
    """Documents sent in batches to a store, here files in the shared folder, and read back."""
    folder = scratch_path(spark, "sink")

    def make_writer():
        import json
        import os
        import uuid
        from urllib.parse import urlparse

        path = urlparse(folder).path
        os.makedirs(path, exist_ok=True)

        def write(documents):
            with open(os.path.join(path, f"{uuid.uuid4().hex}.json"), "w") as out:
                out.writelines(json.dumps(d) + "\n" for d in documents)

        return write

    rows = products(spark, sf).select("_id", "name", "price")
    write_batches(rows, make_writer, batch_size=100)
    return spark.read.schema(rows.schema).json(folder)


@query("sink_data_source", f"WITH {PRODUCTS_SQL} SELECT _id, name, price FROM products")
def _(spark, sf):
    """The same documents through a data source: staged by tasks, published when the job commits."""
    folder = scratch_path(spark, "sink")
    rows = products(spark, sf).select("_id", "name", "price")
    register_sink(spark, "product_documents", JsonFolder(folder))
    send(rows, "product_documents", batch_size=100)
    return spark.read.schema(rows.schema).json(folder)


# --- The product table --------------------------------------------------------------------------

_ITEMS = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("color", T.StringType()),
    ]
)
_STORED_SQL = """stored AS (SELECT CAST(p_partkey AS VARCHAR) AS _id, p_retailprice AS price,
    p_name AS description, p_brand AS color FROM part)"""
# Updates without a color, and without a price where no quality is known.
_UPDATES_SQL = """incoming AS (SELECT CAST(doc_id * 3 AS VARCHAR) AS _id,
    CASE WHEN quality IS NOT NULL THEN n_chars / 100.0e0 END AS price, text AS description
    FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))"""


def stored_items(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("_id"),
        F.col("p_retailprice").alias("price"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("color"),
    )


def item_updates(spark, sf):
    quality = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return table(spark, sf, "documents").join(quality, "doc_id", "left").select(
        (F.col("doc_id") * 3).cast("string").alias("_id"),
        F.when(F.col("quality").isNotNull(), F.col("n_chars") / 100.0).alias("price"),
        F.col("text").alias("description"),
    )


@query("insert_catalog", f"WITH {_STORED_SQL} SELECT * FROM stored")
def _(spark, sf):
    items = CatalogTable(spark, scratch_path(spark, "items"), _ITEMS)
    items.reset()
    items.insert(stored_items(spark, sf))
    return items.read()


@query(
    "upsert_catalog",
    f"""WITH {_STORED_SQL}, {_UPDATES_SQL}
    SELECT coalesce(i._id, s._id) AS _id, CASE WHEN i._id IS NOT NULL THEN i.price ELSE s.price END AS price,
           CASE WHEN i._id IS NOT NULL THEN i.description ELSE s.description END AS description, s.color AS color
    FROM stored s FULL JOIN incoming i ON s._id = i._id""",
)
def _(spark, sf):
    items = VersionedTable(spark, scratch_path(spark, "items"), _ITEMS)
    items.insert(stored_items(spark, sf))
    items.upsert(item_updates(spark, sf))
    return items.read()


# --- Complete runs ------------------------------------------------------------------------------


def hashed(df, columns):
    return enrich.hashed_embeddings(df, columns, DIMS)


def offline(spark, sf, raw):
    assets = stored_assets(spark, sf)
    models = OfflineModels(
        add_assets=lambda df: join_assets(df, assets),
        make_describer=make_describer,
        make_classifier=make_classifier,
        embed=hashed,
    )
    return enrich.enrich_offline(raw, models, partitions=spark.sparkContext.defaultParallelism)


# Pictures, descriptions, labels and the two embeddings of one delivery, as a CTE chain. The
# embeddings are reported by size and by the sum of their weights.
def enriched_sql(raw: str, name: str) -> str:
    return f"""
{name}_text AS (
  SELECT name, {raw}.img AS img, price, rating, id,
         concat(name, ' in ', CAST(octet_length(assets.img) AS VARCHAR), ' bytes') AS description
  FROM {raw} JOIN assets ON {raw}.url = assets.url WHERE octet_length(assets.img) > 0
),
{embedding_sql(f'{name}_n', f'{name}_text', 'name', 'name')},
{embedding_sql(f'{name}_d', f'{name}_text', 'name', 'description')},
{name} AS (
  SELECT name AS _id, name, img, price, rating, description, {LABELS_SQL},
         CAST({DIMS} AS INTEGER) AS dims, nw AS name_weight, dw AS description_weight
  FROM {name}_text
  JOIN (SELECT name, round(sum(CAST(weight AS DOUBLE)), 6) AS nw FROM {name}_n GROUP BY name) USING (name)
  JOIN (SELECT name, round(sum(CAST(weight AS DOUBLE)), 6) AS dw FROM {name}_d GROUP BY name) USING (name)
)"""


def report(records):
    """Replace the embeddings by their size and the sum of their weights."""
    total = lambda c: F.round(
        F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6
    )
    return records.select(
        "_id", "name", "img", "price", "rating", "description", "category", "season", "color",
        F.size("description_embedding").alias("dims"),
        total("name_embedding").alias("name_weight"),
        total("description_embedding").alias("description_weight"),
    )


@query("enrich_offline", f"WITH {raw_sql('raw')}, {_ASSETS}, {enriched_sql('raw', 'done')} SELECT * FROM done")
def _(spark, sf):
    return report(offline(spark, sf, raw_products(spark, sf)))


class StubClient:
    """Remote services that know no picture whose address ends in 3."""

    def __init__(self):
        self.encoder = make_encoder()

    def describe(self, prompt, image_url):
        if image_url.endswith("3"):
            raise TimeoutError
        return f"{image_url} shows: {prompt[-20:]}"

    def classify(self, prompt):
        title = prompt.split("\n")[0].removeprefix("Product title: ")
        if "Which category" in prompt:
            return category_answer(title)
        return season_answer(title) if "Which season" in prompt else color_answer(title)

    def embed(self, text):
        return self.encoder([text])[0]


def make_encoder():
    """Two numbers per text."""
    return lambda texts: [[float(len(text)), 1.0] for text in texts]


def online(raw, **options):
    return enrich.enrich_online(raw, StubClient, **options)


_REMOTE_TEXT = "concat(url, ' shows: ', right(concat('The product is called: ', name, '.'), 20))"
_ONLINE = f"""
answered AS (
  SELECT id, name, img, price, rating, CASE WHEN url NOT LIKE '%3' THEN {_REMOTE_TEXT} END AS description FROM {{raw}}
),
complete AS (
  SELECT name AS _id, name, img, price, rating, description,
         CASE WHEN length(name) % 2 = 1 THEN 'Footwear' END AS category,
         CASE length(name) % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' ELSE 'Fall' END AS season,
         {label_sql("concat('the color is ', name)", COLORS)} AS color
  FROM answered WHERE description IS NOT NULL
)"""


@query(
    "enrich_online",
    f"""WITH {raw_sql('raw')}, {_ONLINE.format(raw='raw')} SELECT *, CAST(length(name) AS DOUBLE) AS name_size,
    CAST(length(description) AS DOUBLE) AS text_size FROM complete
    WHERE rating IS NOT NULL AND category IS NOT NULL AND color IS NOT NULL""",
)
def _(spark, sf):
    records = online(raw_products(spark, sf), partitions=spark.sparkContext.defaultParallelism)
    size = lambda c: F.element_at(c, 1).cast("double")
    return records.drop("id").withColumns(
        {"name_size": size("name_embedding"), "text_size": size("description_embedding")}
    ).drop("name_embedding", "description_embedding")


@query(
    "null_propagation",
    f"""WITH {raw_sql('raw0')}, raw AS (SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN name END AS name) FROM raw0),
    {_ONLINE.format(raw='raw')}
    SELECT name AS _id, CASE WHEN name IS NOT NULL THEN description END AS description,
           CASE WHEN length(name) % 2 = 1 AND description IS NOT NULL THEN 'Footwear' END AS category,
           CASE WHEN description IS NOT NULL THEN CASE length(name) % 4 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Winter'
             WHEN 2 THEN 'Spring' WHEN 3 THEN 'Fall' END END AS season,
           CASE WHEN description IS NOT NULL AND name IS NOT NULL THEN {label_sql("concat('the color is ', name)", COLORS)} END AS color,
           CAST(length(name) AS DOUBLE) AS name_size,
           CASE WHEN name IS NOT NULL THEN CAST(length(description) AS DOUBLE) END AS text_size FROM answered""",
)
def _(spark, sf):
    """What depends on a missing description or name is missing too, and the rows stay. Some have no id."""
    raw = raw_products(spark, sf)
    raw = raw.withColumn("name", F.when(F.col("id") % 11 != 0, F.col("name")))
    raw = raw.withColumn("id", F.when(F.col("id") % 7 != 0, F.col("id")))
    records = online(raw, require_complete=False, partitions=spark.sparkContext.defaultParallelism)
    size = lambda c: F.element_at(c, 1).cast("double")
    return records.select(
        "_id", "description", "category", "season", "color",
        size("name_embedding").alias("name_size"), size("description_embedding").alias("text_size"),
    )


@query(
    "embed_columns",
    f"""WITH {DESCRIBED_SQL} SELECT _id, CAST(length(name) AS FLOAT) AS name_size,
    CAST(length(description) AS FLOAT) AS text_size FROM described""",
)
def _(spark, sf):
    rows = embed_columns(
        described(spark, sf).select("_id", "name", "description"), ["name", "description"], make_encoder
    )
    return rows.select(
        "_id",
        F.element_at("name_embedding", 1).alias("name_size"),
        F.element_at("description_embedding", 1).alias("text_size"),
    )


@query(
    "catalog_first_run",
    f"WITH {raw_sql('raw')}, {_ASSETS}, {enriched_sql('raw', 'done')} SELECT * FROM done",
)
def _(spark, sf):
    items = VersionedTable(spark, scratch_path(spark, "catalog"))
    return report(enrich.enrich_into(items, raw_products(spark, sf), lambda raw: offline(spark, sf, raw), "first_run"))


_UPDATED = f"""WITH {raw_sql('raw')}, {raw_sql('raw2', 100, 1.5)}, {_ASSETS}, {enriched_sql('raw', 'done')},
{enriched_sql('raw2', 'again')}
SELECT * FROM again UNION ALL SELECT * FROM done WHERE _id NOT IN (SELECT _id FROM again)"""


@query("catalog_update", _UPDATED)
def _(spark, sf):
    """A second delivery: new prices for names that are stored already, and new names."""
    items = VersionedTable(spark, scratch_path(spark, "catalog"))
    enriched = lambda raw: offline(spark, sf, raw)
    enrich.enrich_into(items, raw_products(spark, sf), enriched, "first_run")
    return report(enrich.enrich_into(items, raw_products(spark, sf, 100, 1.5), enriched, "update"))


@query("stream_update", _UPDATED)
def _(spark, sf):
    """Both deliveries arrive as files; the second is upserted over the first."""
    items = VersionedTable(spark, scratch_path(spark, "catalog"))
    arrivals, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "checkpoint")
    for raw in (raw_products(spark, sf), raw_products(spark, sf, 100, 1.5)):
        raw.write.mode("append").parquet(arrivals)
        start_updates(spark, arrivals, items, lambda df: offline(spark, sf, df), checkpoint).awaitTermination()
    return report(items.read())

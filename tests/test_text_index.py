"""A text index that follows its table, and searches that stop early."""

import random

import pytest
from pyspark.sql import functions as F

from test_search import WORDS
from test_tables import rows_of
from wareseek.operators import text_index
from wareseek.operators.filters import Conditions
from wareseek.operators.lexical import LexicalIndex, score_names
from wareseek.operators.ranking import top_n
from wareseek.operators.text_index import TextIndex
from wareseek.plans.enrich import load
from wareseek.plans.search import batch_lexical_search, lexical_search
from wareseek.sources import versions
from wareseek.sources.versions import VersionedTable
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("_id", "name", "img", "category", "season", "color")]
    + [T.StructField(c, T.DoubleType()) for c in ("price", "rating")]
)
TEXTS = ["red hat", "hat", "blue shoe red", "men's long long", "zzz", "", "unseen hat"]


def product(key, name, rng):
    return key, name, "img", rng.choice(["Tops", "Bottoms"]), "Summer", "Red", float(rng.randint(1, 100)), rng.choice([1.0, 5.0])


def names(rng):
    return rng.choice([None, "", "red hat", "red hat", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))])


def check(table, index, texts=(), where=None):
    """The index equals a new one, and its searches equal scans of all names."""
    rows = table.read()
    view, new = index.index(), LexicalIndex.of(rows)
    assert rows_of(view.postings.drop("bucket")) == rows_of(new.postings)
    assert rows_of(view.terms.select("term", "df", "total_tf")) == rows_of(new.terms)
    assert rows_of(view.corpus) == rows_of(new.corpus)
    for text in texts:
        scanned = score_names(rows, text)
        want = top_n((scanned if where is None else scanned.filter(where)).select("_id", "score"), 7).collect()
        found = index.best(rows, text, 7, where, first_blocks=1).select("_id", "score")
        assert top_n(found, 7).collect() == want, text


@pytest.mark.parametrize("delta_rows", [0, 50_000])
def test_index_follows_updates(spark, tmp_path, monkeypatch, delta_rows):
    monkeypatch.setattr(versions, "MAX_DELTA_ROWS", delta_rows)
    monkeypatch.setattr(text_index, "BLOCK_ROWS", 16)
    rng = random.Random(delta_rows)
    table = VersionedTable(spark, str(tmp_path / "table"), SCHEMA, buckets=3)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    make = lambda keys: spark.createDataFrame([product(f"k{i:03d}", names(rng), rng) for i in keys], SCHEMA)
    load(table, make(range(120)), "first_run", index=index)
    load(table, make(rng.sample(range(150), 40)), "update", index=index)
    # Only a price: nothing of the index changes.
    load(table, spark.createDataFrame([("k001", 3.0)], "_id string, price double"), "update", index=index)
    assert index._segments("removed", index.manifest.latest()[1]).filter("seq = 3").count() == 0
    check(table, index, TEXTS[:3], F.col("rating") > 2)
    table.compact()
    index.follow(table)
    version = index.manifest.latest()[0]
    index.follow(table)
    assert index.manifest.latest()[0] == version
    index.compact()
    check(table, index, TEXTS[3:] if delta_rows else ())
    table.upsert(make([3]))
    table.expire(keep=1, grace_seconds=-60)
    index.follow(table)  # the version it knew is gone, so it is built again
    index.expire(keep=1, grace_seconds=-60)
    check(table, index)


def test_an_update_that_dies_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    table = VersionedTable(spark, str(tmp_path / "table"), SCHEMA, buckets=2)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    load(table, spark.createDataFrame([product("a", "red hat", rng)], SCHEMA), "first_run", index=index)
    before = rows_of(index.index().postings)
    table.upsert(spark.createDataFrame([("a", "blue shoe")], "_id string, name string"))
    with monkeypatch.context() as patch:
        patch.setattr(versions.Manifest, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.follow(table)
    assert rows_of(index.index().postings) == before
    index.follow(table)
    assert {r["term"] for r in index.index().postings.collect()} == {"blue", "shoe"}


def test_a_frequent_word_reads_few_blocks(spark, tmp_path, monkeypatch):
    """Rows that the scan of the postings returns do not grow with the matches."""
    monkeypatch.setattr(text_index, "BLOCK_ROWS", 128)
    read = []
    keys = TextIndex._keys

    def counted(self, entries, folders, chosen):
        found = keys(self, entries, folders, chosen)
        plain = [self._read(e["folder"], "postings") for e in entries]
        mine = [r["block"] for r in chosen]
        scan = plain[0].filter((F.col("term") == "red") & F.col("block").isin(mine) & (F.col("bucket") == folders["red"])).select("_id")
        scan.collect()
        read.append(scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value())
        return found

    monkeypatch.setattr(TextIndex, "_keys", counted)
    for rows in (3_000, 30_000):
        catalog = spark.range(rows).select(
            F.format_string("k%06d", "id").alias("_id"), F.concat(F.lit("red item "), F.col("id") % 10).alias("name")
        )
        catalog.write.parquet(str(tmp_path / f"c{rows}"))
        catalog = spark.read.parquet(str(tmp_path / f"c{rows}"))
        index = TextIndex(spark, str(tmp_path / f"i{rows}"), buckets=2)
        index.create(catalog)
        read.clear()
        got = [r["_id"] for r in top_n(index.best(catalog, "red", 20), 20).collect()]
        assert got == [f"k{i:06d}" for i in range(20)]
        assert len(read) == 1 and read[0] <= 4 * 128


def test_searches_take_the_index(spark, tmp_path):
    rng = random.Random(9)
    table = VersionedTable(spark, str(tmp_path / "table"), SCHEMA, buckets=2)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    load(table, spark.createDataFrame([product(f"k{i}", names(rng), rng) for i in range(200)], SCHEMA), "first_run", index=index)
    conditions, rows = Conditions(0, 60, 0), table.read()
    plain = lexical_search(rows, "red hat", conditions, 9).collect()
    assert lexical_search(rows, "red hat", conditions, 9, index).collect() == plain and plain
    queries = spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, text string")
    batch = lambda given: rows_of(batch_lexical_search(rows, queries, conditions, 5, given))
    assert batch(index) == batch(None)


def test_nothing_to_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    empty = spark.createDataFrame([], SCHEMA)
    assert index.best(empty, "red", 5).count() == 0
    index.create(empty)
    assert index.best(empty, "red", 5).count() == 0 and index.index().postings.count() == 0

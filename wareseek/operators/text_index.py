"""A stored text index that follows its table, and top-n search that reads only blocks that can matter.

The index is a list of segments. An update adds one: the postings of changed products, the keys whose older
postings no longer count, and the change of the statistics as signed sums. Statistics over all segments are
plain sums, so a search sees what a rebuilt index would show. ``compact`` writes one segment again. Versions are
published through a manifest, with the version of the table that they reflect.

Within a segment, postings are sorted by term and falling impact and cut into blocks, and each block's greatest
term count and least length bound what any of its postings can add to a score. A search reads the best
blocks of each word, scores the products found there exactly, and ends when all that is unread cannot
reach the n-th best.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from wareseek.functions.text import split_tokens, tokens
from wareseek.operators.lexical import LexicalIndex, _folder, build_postings, relevance, tf_weight
from wareseek.operators.ranking import top_n
from wareseek.sources.versions import Manifest, VersionedTable
from wareseek.storage import is_small, materialise, rows_if_at_most

BLOCK_ROWS = 1_024
# Blocks of each word that a search reads first, and how many times more in the next round.
FIRST_BLOCKS = 2
MORE_BLOCKS = 4
MAX_BROADCAST_KEYS = 1_000_000
# Products found that are named in the scan filter of the catalog.
MAX_KEYS_IN_FILTER = 10_000
_TABLE = "table"
# Scores are rounded to nine digits, bounds are not.
_ROUNDING = 2e-9


class TextIndex:
    """Segments of postings below ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str = "_id",
        text: str = "name",
        buckets: int = 64,
        key_type: str = "string",
    ) -> None:
        self.spark, self.path, self.key, self.text, self.buckets = spark, path, key, text, buckets
        self.key_type = key_type
        self.manifest = Manifest(spark, f"{path}/manifest")

    # --- Writing -------------------------------------------------------------------------------

    def create(self, catalog: DataFrame, table_version: int | None = None) -> None:
        """One segment with all rows of the catalog."""
        version, _ = self.manifest.latest()
        rows = catalog.select(self.key, self.text)
        self._publish(version + 1, [], self._write(rows, rows.limit(0), version + 1), table_version)

    def update(self, before: DataFrame, after: DataFrame, table_version: int | None = None) -> None:
        """A segment for the rows whose text is new, other or gone, of some keys before and after a change."""
        version, entries = self.manifest.latest()
        old = before.select(self.key, F.col(self.text).alias("_old"), F.lit(True).alias("_had"))
        new = after.select(self.key, F.col(self.text).alias("_new"), F.lit(True).alias("_has"))
        changed = old.join(new, self.key, "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
        changed = materialise(changed, "changed-texts")
        side = lambda column, flag: changed.filter(flag).select(self.key, F.col(column).alias(self.text))
        segment = self._write(side("_new", "_has"), side("_old", "_had"), version + 1)
        self._publish(version + 1, [e for e in entries if e["role"] == "segment"], segment, table_version)

    def follow(self, table: VersionedTable) -> None:
        """Bring the index to the newest version of its table, over the rows that may have changed only."""
        newest, entries = table.manifest.latest()
        seen = next((e["seq"] for e in self.manifest.latest()[1] if e["role"] == "batch"), None)
        if seen == newest:
            return
        if seen is None or seen not in table.manifest.versions():
            self.create(table.read(), newest)
            return
        earlier = table.manifest.entries(seen)
        of = lambda rows, role: {(e["bucket"], e["folder"]) for e in rows if e["role"] == role}
        rewritten = {bucket for bucket, _ in of(entries, "base") ^ of(earlier, "base")}
        added = of(entries, "delta") - of(earlier, "delta")
        keys = table._changed([e for e in entries if (e["bucket"], e["folder"]) in added])
        touched = set(rewritten)
        if keys is not None:
            keys = materialise(table._bucketed(keys.select(self.key).distinct()), "changed-keys")
            touched |= {r[0] for r in keys.select("_bucket").distinct().collect()}
        rows = lambda version: table._rows(version, touched)
        if not rewritten and keys is not None:  # deltas alone: their keys are few
            only = F.broadcast(keys.select(self.key))
            rows = lambda version: table._rows(version, touched).join(only, self.key, "left_semi")
        self.update(rows(earlier), rows(entries), newest)

    def compact(self) -> None:
        """Write the live postings as one segment; searches give the same results."""
        version, entries = self.manifest.latest()
        if sum(e["role"] == "segment" for e in entries) < 2:
            return
        view = self.index()
        name = uuid.uuid4().hex
        folder = self._segment(name)
        self._write_postings(name, view.postings.select(self.key, "term", "tf", "length", "bucket"))
        view.terms.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/terms")
        self._sums(entries).write.parquet(f"{folder}/corpus")
        view.postings.select(self.key).limit(0).write.parquet(f"{folder}/removed")
        seen = next((e["seq"] for e in entries if e["role"] == "batch"), None)
        self._publish(version + 1, [], name, seen)

    def expire(self, keep: int = 2, grace_seconds: float = 86_400) -> None:
        """Remove versions but the newest ``keep``, and segments no version lists, once they are old enough."""
        self.manifest.expire(f"{self.path}/segments", keep, grace_seconds)

    def _segment(self, name: str) -> str:
        return f"{self.path}/segments/{name}"

    def _publish(self, version: int, kept: list[Row], segment: str, table_version: int | None) -> None:
        reflects = [] if table_version is None else [("batch", None, _TABLE, table_version)]
        self.manifest.publish(version, [*kept, ("segment", None, segment, version), *reflects])

    def _write(self, added: DataFrame, removed: DataFrame, seq: int) -> str:
        name = uuid.uuid4().hex
        folder = self._segment(name)
        bucket = _folder(self.buckets).alias("bucket")
        self._write_postings(name, build_postings(added, self.text, self.key).select("*", bucket))
        gone = build_postings(removed, self.text, self.key)
        signed = lambda postings, sign: postings.select("term", F.lit(sign).alias("df"), (F.lit(sign) * F.col("tf")).alias("tf"))
        change = signed(self._read(name, "postings"), 1).union(signed(gone, -1))
        terms = change.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total_tf"))
        terms.select("*", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/terms")
        # One row per text that has a token: its length.
        lengths = lambda rows, sign: rows.select(
            F.size(tokens(F.col(self.text))).alias("length"), F.lit(sign).alias("sign")
        ).filter("length > 0")
        both = lengths(added, 1).union(lengths(removed, -1))
        sums = both.agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("length")).alias("total_length"))
        sums.na.fill(0).write.parquet(f"{folder}/corpus")
        removed.select(self.key).write.parquet(f"{folder}/removed")
        return name

    def _write_postings(self, name: str, postings: DataFrame) -> None:
        """Postings sorted by term and impact in numbered blocks, and what each block can add at most."""
        order = [F.col("bucket"), F.col("term"), F.col("tf").desc(), F.col("length"), F.col(self.key)]
        placed = postings.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = placed.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS))
        target = f"{self._segment(name)}/postings"
        # Pages as long as blocks: a filter on blocks then reads their pages and not the row group.
        placed.write.partitionBy("bucket").option("parquet.page.row.count.limit", BLOCK_ROWS).parquet(target)
        blocks = self._read(name, "postings").groupBy("bucket", "term", "block").agg(
            F.max("tf").alias("max_tf"), F.min("length").alias("min_length"),
            F.min(self.key).alias("min_key"), F.count(F.lit(1)).alias("rows"),
        )
        blocks = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        blocks.write.partitionBy("bucket").parquet(f"{self._segment(name)}/blocks")

    # --- Reading -------------------------------------------------------------------------------

    def _read(self, name: str, part: str) -> DataFrame:
        schema = {
            "postings": f"{self.key} {self.key_type}, term string, tf int, length int, block long, bucket int",
            "blocks": f"term string, block long, max_tf int, min_length int, min_key {self.key_type}, rows long, bucket int",
            "terms": "term string, df long, total_tf long, bucket int",
            "corpus": "docs long, total_length long",
            "removed": f"{self.key} {self.key_type}",
        }
        return self.spark.read.schema(schema[part]).parquet(f"{self._segment(name)}/{part}")

    def _segments(self, part: str, entries: list[Row]) -> DataFrame:
        """One part of all segments, with the version that each came with."""
        read = lambda e: self._read(e["folder"], part).withColumn("seq", F.lit(e["seq"]))
        return reduce(DataFrame.unionAll, [read(e) for e in entries if e["role"] == "segment"])

    def _sums(self, entries: list[Row]) -> DataFrame:
        sums = self._segments("corpus", entries).agg(F.sum("docs").alias("docs"), F.sum("total_length").alias("total_length"))
        return sums.select(F.col("docs").cast("long"), F.col("total_length").cast("long"))

    def _terms(self, entries: list[Row]) -> DataFrame:
        terms = self._segments("terms", entries)
        if sum(e["role"] == "segment" for e in entries) == 1:
            return terms.drop("seq")
        summed = terms.groupBy("term", "bucket").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))
        return summed.filter("df > 0").select("term", "df", "total_tf", "bucket")

    def index(self) -> LexicalIndex:
        """All live postings and the statistics over them, for searches of any form."""
        _, entries = self.manifest.latest()
        postings = self._segments("postings", entries)
        if sum(e["role"] == "segment" for e in entries) > 1:
            gone = self._segments("removed", entries).groupBy(self.key).agg(F.max("seq").alias("_gone"))
            gone = F.broadcast(gone) if is_small(gone, MAX_BROADCAST_KEYS) else gone
            postings = postings.join(gone, self.key, "left").filter("_gone IS NULL OR seq >= _gone")
        postings = postings.select(self.key, "term", "tf", "length", "bucket")
        mean = F.col("total_length") / F.col("docs")
        corpus = self._sums(entries).select("docs", F.when(F.col("docs") > 0, mean).alias("mean_length"))
        return LexicalIndex(postings, self._terms(entries), corpus, self.key, self.buckets)

    def best(
        self, catalog: DataFrame, text: str, n: int, where: Column | None = None, digits: int = 9, first_blocks: int = FIRST_BLOCKS
    ) -> DataFrame:
        """The ``n`` rows of the catalog that match ``text`` best, with their ``score``, ties by key.

        Scores are those of :func:`score_names`. ``catalog`` is the table that the index reflects; conditions
        filter rows, and statistics cover all of it.
        """
        repeats = Counter(split_tokens(text))
        _, entries = self.manifest.latest()
        nothing = catalog.limit(0).withColumn("score", F.lit(0.0))
        if not repeats or not entries:
            return nothing
        words = self.spark.createDataFrame([(w,) for w in repeats], "term string")
        folders = {r["term"]: r["bucket"] for r in words.select("term", _folder(self.buckets).alias("bucket")).collect()}
        asked = F.col("bucket").isin(list(set(folders.values()))) & F.col("term").isin(list(folders))
        frequency = {r["term"]: r["df"] for r in self._terms(entries).filter(asked).collect()}
        docs, total = self._sums(entries).first()
        repeats = {w: times for w, times in repeats.items() if frequency.get(w)}
        if not repeats:
            return nothing
        mean = total / docs
        weight = {w: times * math.log(1 + (docs - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w, times in repeats.items()}
        scored = catalog if where is None else catalog.filter(where)
        listed = F.array(*[F.lit(w) for w in repeats])
        scored = scored.withColumn("_tokens", tokens(F.col(self.text))).filter(F.arrays_overlap("_tokens", listed))
        counts = {w: F.lit(frequency[w]) for w in repeats}
        score = relevance("_tokens", repeats, F.lit(docs), counts, F.lit(mean), digits)
        scored = scored.withColumn("score", score).drop("_tokens")
        blocks = self._segments("blocks", entries).filter(asked)
        blocks = blocks.withColumn("reach", _reach(weight, mean))
        width = first_blocks
        while True:
            chosen, unread = self._chosen(blocks, width)
            found = self._among(scored, self._keys(entries, folders, chosen))
            leaders = top_n(found.select(self.key, "score"), n, tie=self.key).collect()
            if not unread or self._settled(leaders, n, unread):
                return self._among(scored, [r[self.key] for r in leaders]) if leaders else nothing
            width *= MORE_BLOCKS

    def _chosen(self, blocks: DataFrame, width: int) -> tuple[list[Row], list[Row]]:
        """The ``width`` blocks of each word that reach highest, and the next one where there are more."""
        order = Window.partitionBy("term").orderBy(F.col("reach").desc(), "min_key", "seq", "block")
        ranked = blocks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= width + 1).collect()
        return [r for r in ranked if r["place"] <= width], [r for r in ranked if r["place"] > width]

    def _keys(self, entries: list[Row], folders: dict[str, int], chosen: list[Row]) -> DataFrame:
        """Keys of the postings in the chosen blocks."""
        parts = []
        for entry in (e for e in entries if e["role"] == "segment"):
            mine: dict[str, list[int]] = {}
            for row in chosen:
                if row["seq"] == entry["seq"]:
                    mine.setdefault(row["term"], []).append(row["block"])
            if mine:
                of = [
                    (F.col("bucket") == folders[w]) & (F.col("term") == w) & F.col("block").isin(numbers)
                    for w, numbers in mine.items()
                ]
                parts.append(self._read(entry["folder"], "postings").filter(reduce(or_, of)).select(self.key))
        return reduce(DataFrame.unionAll, parts).distinct()

    def _among(self, rows: DataFrame, keys: DataFrame | list) -> DataFrame:
        """The rows with these keys: named in the scan filter when they are few, else joined."""
        if isinstance(keys, DataFrame):
            few = rows_if_at_most(keys, MAX_KEYS_IN_FILTER)
            if few is None:
                found = materialise(keys, "keys")
                found = F.broadcast(found) if is_small(found, MAX_BROADCAST_KEYS) else found
                return rows.join(found, self.key, "left_semi")
            keys = [r[0] for r in few]
        return rows.filter(F.col(self.key).isin(keys))

    def _settled(self, leaders: list[Row], n: int, unread: list[Row]) -> bool:
        """Whether nothing in the unread blocks can come before the last of ``n`` leaders.

        An unread product has all its words in unread blocks. It reaches the sum of what those can add at most, and
        that sum only with a key that is in the best unread block of every word.
        """
        if len(leaders) < n:
            return False
        last, most = leaders[-1], sum(r["reach"] for r in unread)
        if most < last["score"] - _ROUNDING:
            return True
        return most <= last["score"] + _ROUNDING and any(r["min_key"] > last[self.key] for r in unread)


def _reach(weight: dict[str, float], mean_length: float) -> Column:
    """What a posting of a block adds to a score at most."""
    of_word = F.create_map(*[x for w, value in weight.items() for x in (F.lit(w), F.lit(value))])
    return of_word[F.col("term")] * tf_weight(F.col("max_tf"), F.col("min_length"), F.lit(mean_length))

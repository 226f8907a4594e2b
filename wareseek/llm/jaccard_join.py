"""Documents whose sets of word n-grams are similar, joined over prefix trees.

Sets are ordered by one global order, rare n-grams first. Two sets of similarity t then share m
members or more among each one's first ``n - ceil(t n) + m``. With m at a twentieth of the set,
counting tells most sets that merely share a passage apart from similar ones. The rest, where they
share one of those members and are of fitting sizes, fall into one cluster, a coarse one that
holds every possible link. Inside a cluster the ordered sets are kept
in a trie with joined paths, and each set is traversed against it: sets with a common beginning
share the overlap counted so far, and a subtree is left as soon as what remains on both sides
cannot reach the overlap that its sizes ask for. Where a subtree already belongs to the
component of the traversing set, it can add nothing and is skipped.

How rare an n-gram is comes from a table of counts with a fixed number of cells. N-grams that share
a cell count together; that makes the order coarser but never a result wrong, as every order gives
the same links. Clusters of many sets are cut into shards of ``SHARD_SETS`` whose tries all
sets of the cluster traverse, so the memory of a task is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wareseek.llm.common import mixed, slices
from wareseek.llm.components import components
from wareseek.storage import is_small, materialise

GRAM = 5
PERCENT = 80
SHARD_SETS = 1000
_CELL_BITS = 23
_CELL_BLOCK_BITS = 15
_WANTED_BITS = 26
_ROWS = 256
_REMEMBERED = 500_000
_MAX_BROADCAST_NODES = 500_000
_LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-gram sets of texts, from hashes of their lower-cased words."""

    def __init__(self, size: int):
        self._size = size

    def set_of(self, text: bytes) -> np.ndarray:
        """The sorted distinct hashes of a text's n-grams; of all its words when they are fewer."""
        words = text.lower().split()  # of bytes: A to Z, and the six spaces of ASCII
        if not words:
            return np.empty(0, dtype=np.uint64)
        # Hashing a word takes no longer than looking it up among many.
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        size = min(self._size, len(words))
        grams = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for i in range(size):
            grams = grams * _BASE + hashes[i : i + len(grams)]
        return np.unique(mixed(grams + np.uint64(size)))


def set_key(grams: np.ndarray) -> int:
    """A hash of a whole set: equal sets are one node of the join."""
    total = mixed(grams ^ _BASE).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mixed(np.array([total]))[0].view(np.int64))


def needed(first: int, second: int, percent: int) -> int:
    """The least overlap of two sets of these sizes that makes a link."""
    return -(-percent * (first + second) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """How many first members of a set of n to look at, for two similar sets to share ``shared_by``."""
    return min(n, n - -(-percent * n // 100) + shared_by(n))


def shared_by(n: int) -> int:
    return 1 + n // 20


def least_shared(n: int, percent: int) -> int:
    """How many of its first members a set shares with a similar one, which may be smaller."""
    return shared_by(-(-percent * n // 100))


def _summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each text with its set's key, and at the end this task's counts by cell."""
    names = ["_id", "_hash", "n", "node", "block", "counts"]
    grams = Grams(size)
    cells = np.zeros(1 << _CELL_BITS, dtype=np.uint8)
    used = False
    for batch in slices(batches, _ROWS):
        n, nodes, all_cells = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = grams.set_of(text)
            n.append(len(found))
            nodes.append(set_key(found) if len(found) else None)
            all_cells.append(found >> np.uint64(64 - _CELL_BITS))
        counted = np.unique(np.concatenate(all_cells), return_counts=True)
        place = counted[0].astype(np.int64)
        cells[place] = np.minimum(cells[place] + counted[1], 255).astype(np.uint8)
        used = True
        none = [None] * batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_hash"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
             pa.array(none, pa.int32()), pa.array(none, pa.binary())],
            names,
        )
    if used:
        blocks = cells.reshape(-1, 1 << _CELL_BLOCK_BITS)
        kept = [i for i in range(len(blocks)) if blocks[i].any()]
        none = pa.array([None] * len(kept), pa.int64())
        data = pa.array([blocks[i].tobytes() for i in kept], pa.binary())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(kept, pa.int32()), data], names)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one block, sorted by block, added up and put on a logarithmic scale of one byte."""
    current, total = None, None

    def row() -> pa.RecordBatch:
        level = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"]
        )

    for batch in slices(batches, 64):
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            if block != current:
                if current is not None:
                    yield row()
                current, total = block, np.zeros(1 << _CELL_BLOCK_BITS)
            total += np.frombuffer(counts, dtype=np.uint8)
    if current is not None:
        yield row()


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The n-grams of a set in the global order: by level, then by hash."""
    level = levels[(grams >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
    return grams[np.argsort(level, kind="stable")]


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, table) -> Iterator[pa.RecordBatch]:
    """The first members of each set, once for equal sets of a task."""
    grams = Grams(size)
    levels = np.frombuffer(table.value, dtype=np.uint8)
    seen: set[int] = set()
    for batch in slices(batches, _ROWS):
        columns: list[list[np.ndarray]] = [[], [], []]
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = grams.set_of(text)
            n = len(found)
            node = set_key(found) if n else None
            if not n or node in seen:
                continue
            if len(seen) < _REMEMBERED:
                seen.add(node)
            first = ordered(found, levels)[: prefix_size(n, percent)]
            for column, values in zip(columns, (first.view(np.int64), np.full(len(first), n), np.full(len(first), node))):
                column.append(values)
        if columns[0]:
            arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "n", "node"])


def _runs(batches: Iterator[pa.RecordBatch], percent: int):
    """The rows of n-grams met twice, with whether a row begins a run.

    Rows are sorted by n-gram, size and node; a run ends where a size is too large for the one
    before, since no sets on its two sides can be similar.
    """
    last_gram = last_n = None
    for batch in slices(batches, 20_000):
        gram, n, node = (batch.column(c).to_numpy() for c in ("gram", "n", "node"))
        # The last row of a batch may begin a run that the next batch goes on with.
        same = gram[1:] == gram[:-1]
        shared = np.concatenate([same, [True]]) | np.concatenate([[gram[0] == last_gram], same])
        rows = []
        for g, size, key in zip(gram[shared].tolist(), n[shared].tolist(), node[shared].tolist()):
            rows.append((g, size, key, g != last_gram or 100 * last_n < percent * size))
            last_gram, last_n = g, size
        yield rows


def _shared_members(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of runs with two nodes or more, each node once."""
    waiting = last_node = None
    for rows in _runs(batches, percent):
        kept = []
        for g, n, node, begins in rows:
            if begins:
                waiting, last_node = (g, n, node), node
            elif node != last_node:
                if waiting is not None:
                    kept.append(waiting)
                kept.append((g, n, node))
                waiting, last_node = None, node
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], ["gram", "n", "node"])


def _coarse_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links the nodes of each run to its first."""
    hub = None
    sent: set[tuple[int, int]] = set()
    for rows in _runs(batches, percent):
        links = []
        for _, _, node, begins in rows:
            if begins:
                hub = node
            elif node != hub and (hub, node) not in sent:
                if len(sent) < _REMEMBERED:
                    sent.add((hub, node))
                links.append((hub, node))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def _whole_sets(batches: Iterator[pa.RecordBatch], size: int, table, wanted) -> Iterator[pa.RecordBatch]:
    """The ordered sets of texts that may stand for a wanted node."""
    grams = Grams(size)
    levels = np.frombuffer(table.value, dtype=np.uint8)
    bits = np.frombuffer(wanted.value, dtype=np.uint8)
    names = ["node", "_id", "_hash", "members"]
    for batch in slices(batches, 64):
        key, digest = (batch.column(c).to_numpy() for c in ("_id", "_hash"))
        place = batch.column("place").to_numpy()
        rows = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        if not len(rows):
            continue
        texts = batch.column("text").take(pa.array(rows)).cast(pa.binary()).to_pylist()
        sets = [ordered(s, levels) for s in map(grams.set_of, texts)]
        rows = [r for r, s in zip(rows.tolist(), sets) if len(s)]
        sets = [s for s in sets if len(s)]
        if not sets:
            continue
        columns = [pa.array([set_key(np.sort(s)) for s in sets], pa.int64()), pa.array(key[rows]), pa.array(digest[rows])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], names)


class Node:
    """A path of the trie without branches, and what hangs below it."""

    __slots__ = ("path", "below", "least", "most", "ends", "sample", "uniform")

    def __init__(self, path: list[int], least: int, most: int, sample: int):
        self.path = path
        self.below: dict[int, Node] = {}
        self.least, self.most = least, most
        self.ends: list[int] = []
        self.sample, self.uniform = sample, True


class Trie:
    """Ordered sets, with a forest of the links found so far."""

    def __init__(self, percent: int):
        self.root = Node([], 0, 0, 0)
        self.percent = percent
        self.size: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def component(self, key: int) -> int:
        parent = self.parent
        while parent.setdefault(key, key) != key:
            parent[key] = parent[parent[key]]
            key = parent[key]
        return key

    def add(self, key: int, members: list[int]) -> None:
        n = len(members)
        self.size[key] = n
        node, at = self.root, 0
        while True:
            if node is not self.root:
                if node.uniform and self.component(node.sample) != self.component(key):
                    node.uniform = False
                node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.ends.append(key)
                return
            child = node.below.get(members[at])
            if child is None:
                leaf = Node(members[at:], n, n, key)
                leaf.ends.append(key)
                node.below[members[at]] = leaf
                return
            path = child.path
            common = 0
            while common < len(path) and at + common < n and path[common] == members[at + common]:
                common += 1
            if common < len(path):  # the path branches here
                upper = Node(path[:common], child.least, child.most, child.sample)
                upper.uniform = child.uniform
                upper.below[path[common]] = child
                child.path = path[common:]
                node.below[members[at]] = upper
                child = upper
            node, at = child, at + common

    def links(self, key: int, members: list[int]) -> list[int]:
        """One similar set from each component that holds any, apart from the set's own."""
        n, percent, size = len(members), self.percent, self.size
        place = {g: i for i, g in enumerate(members)}
        found = []
        # Node, members of the path so far, overlap so far, members of this set passed.
        stack = [(child, 0, 0, 0) for child in self.root.below.values()]
        own = self.component(key)
        while stack:
            node, depth, overlap, passed = stack.pop()
            if node.uniform and self.component(node.sample) == own:
                continue
            least = max(node.least, -(-percent * n // 100))
            if 100 * node.most < percent * n:
                continue
            must = needed(least, n, percent)
            # Members missed on the path may be as many as the largest set can spare.
            alive = True
            for g in node.path:
                depth += 1
                at = place.get(g)
                if at is not None:
                    overlap += 1
                    passed = at + 1
                if overlap + min(node.most - depth, n - passed) < must:
                    alive = False
                    break
            if not alive:
                continue
            for other in node.ends:
                if overlap >= needed(size[other], n, percent) and self.component(other) != own:
                    found.append(other)
                    self.parent[self.component(other)] = own
            stack += [(child, depth, overlap, passed) for child in node.below.values()]
        return found


def _joined(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Streams the sets of each shard, sorted by size, through the trie of those before."""
    shard, trie = None, None
    for batch in slices(batches, 256):
        links = []
        columns = ("cluster", "shard", "node", "added", "members")
        for cluster, part, node, added, members in zip(*(batch.column(c).to_pylist() for c in columns)):
            if (cluster, part) != shard:
                shard, trie = (cluster, part), Trie(percent)
            ids = np.frombuffer(members, dtype=np.uint64).tolist()
            links += [(node, other) for other in trie.links(node, ids)]
            if added:
                trie.add(node, ids)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def similar_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT, hashes: bool = False
) -> DataFrame:
    """For every row: the key, ``n_shingles``, and ``component_id``, the smallest key reached by links.

    Two documents link when their sets have a Jaccard similarity of ``percent`` hundredths or more.
    Words are lower-cased (A to Z only); a text with fewer words than ``gram`` has its whole
    sequence as one member, and a null text or one without words has an empty set, links with
    nothing and is its own component. Equal sets are one node, so copies are never compared.
    Repeated rows each give a row; a null key counts as larger than all others, and only
    components of null keys alone have a null id. An empty table gives no rows. N-grams and sets
    are compared by 64-bit hashes.

    Where keys repeat with other texts, ``hashes`` tells the rows apart: it adds ``text_hash``, the
    xxhash64 of the row's text, and ``component_hash``, that of the row the component is named
    after, the one with the least key and, of those with it, the least hash.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(key), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).select("*", F.xxhash64("text").alias("_hash"))
    read = texts.select("_id", "_hash", "text")
    summary = read.mapInArrow(
        lambda b: _summaries(b, gram), "_id long, _hash long, n long, node long, block int, counts binary"
    )
    summary = materialise(summary, "set-summaries")
    blocks = 1 << (_CELL_BITS - _CELL_BLOCK_BITS)
    levels = bytearray(1 << _CELL_BITS)
    counted = summary.where("block IS NOT NULL").select("block", "counts").repartition(min(blocks, 32), "block")
    found = counted.sortWithinPartitions("block").mapInArrow(_levels, "block int, levels binary")
    for row in found.collect():  # one byte for each of the fixed number of cells
        levels[row["block"] << _CELL_BLOCK_BITS : (row["block"] + 1) << _CELL_BLOCK_BITS] = row["levels"]
    table = spark.sparkContext.broadcast(bytes(levels))
    prefixes = read.select("text").mapInArrow(lambda b: _prefixes(b, gram, percent, table), "gram long, n long, node long")
    by_gram = lambda df: df.repartition("gram").sortWithinPartitions("gram", "n", "node")
    members = "gram long, n long, node long"
    shared = materialise(by_gram(prefixes).mapInArrow(lambda b: _shared_members(b, percent), members), "shared-members")
    least = F.expr(f"1 + (({percent} * max(n) + 99) DIV 100) DIV 20")  # least_shared in SQL
    likely = shared.groupBy("node").agg(F.count(F.lit(1)).alias("found"), least.alias("least"))
    likely = materialise(likely.where("found >= least").select("node"), "likely-nodes")
    coarse = by_gram(shared.join(likely, "node")).mapInArrow(lambda b: _coarse_links(b, percent), "a long, b long")
    clusters = components(coarse).select("node", F.col("root").alias("cluster"))
    sets = summary.where("n > 0").select("_id", "_hash", "n", "node")
    # The first document of each node stands for it; shards of a cluster by its number of nodes.
    stands = F.min(F.struct("_id", "_hash", "n")).alias("first")
    members = clusters.join(sets, "node").groupBy("cluster", "node").agg(stands)
    members = materialise(members.select("cluster", "node", "first.*"), "cluster-nodes")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SHARD_SETS).cast("long").alias("shards"))
    place = F.pmod(F.xxhash64("_id", "_hash"), F.lit(1 << _WANTED_BITS))
    counted_from_one = (place + 1).alias("place")
    bits = bytearray(1 << (_WANTED_BITS - 3))
    marked = members.select(counted_from_one).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    # A bitmap of fixed size says which texts to look at again; others with the same bit drop out below.
    for row in marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        at = (row["bucket"] - 1) * len(row["bits"])
        bits[at : at + len(row["bits"])] = row["bits"]
    wanted = spark.sparkContext.broadcast(bytes(bits))
    whole = read.select("_id", "_hash", "text", place.alias("place")).mapInArrow(
        lambda b: _whole_sets(b, gram, table, wanted), "node long, _id long, _hash long, members binary"
    )
    parts = materialise(members.join(sizes, "cluster").select("cluster", "shards", "node", "_id", "_hash", "n"), "parts")
    # Measured to be small, the list of nodes is sent to the sets, which then move once.
    parts = F.broadcast(parts) if is_small(parts, _MAX_BROADCAST_NODES) else parts
    streams = (
        whole.join(parts, ["node", "_id", "_hash"])
        .select("cluster", "node", "n", "members", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
        .withColumn("added", F.pmod(F.col("node"), F.col("shards")) == F.col("shard"))
        .repartition("cluster", "shard")
        .sortWithinPartitions("cluster", "shard", "n", "node")
        .select("cluster", "shard", "node", "added", "members")
    )
    links = streams.mapInArrow(lambda b: _joined(b, percent), "a long, b long")
    roots = components(links)
    labelled = sets.join(roots, "node", "left").select("_id", "_hash", "n", F.coalesce("root", "node").alias("root"))
    known = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    kind = docs.schema[key].dataType
    out = [known("_id").cast(kind).alias(key), "n_shingles", known("component_id").cast(kind).alias("component_id")]
    columns = ["_id", F.col("n").alias("n_shingles")]
    own = [F.col("_id").alias("component_id")]
    least = labelled.groupBy("root")
    if hashes:
        least = least.agg(F.min(F.struct("_id", "_hash")).alias("first"))
        least = least.select("root", F.col("first._id").alias("component_id"), F.col("first._hash").alias("component_hash"))
        columns.append(F.col("_hash").alias("text_hash"))
        own.append(F.col("_hash").alias("component_hash"))
        out += ["text_hash", "component_hash"]
    else:
        least = least.agg(F.min("_id").alias("component_id"))
    named = labelled.join(least, "root").select(*columns, *[c for c in least.columns if c != "root"])
    empty = summary.where("n = 0").select(*columns, *own)
    return named.union(empty).select(*out)

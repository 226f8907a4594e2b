"""Sampled segmentations of texts into vocabulary pieces, distinct and with inclusion scores.

The lattice of a text has an edge for every piece that fits at a place; a path through it is a
segmentation, and its score the sum of its pieces' log-probabilities. Pieces of the model have
ranks, not probabilities, so a piece of rank r weighs ``1 / (r + 1)``, sharpened by ``power``.

Adding Gumbel noise to all paths' log-probabilities and taking the k largest draws k paths without
replacement. The search need not see all paths: the noisy maximum of a set of paths is Gumbel with
the set's log-sum, and given the maximum of a set, those of its parts are drawn from truncated
Gumbels. So an A-star search, whose bound is the noisy maximum itself, goes straight to a leaf:
at each node it draws the best child, which keeps the maximum, and one maximum for all other
children together, which waits on the frontier. The next path starts at the frontier's largest
value, and no node is opened that is not on a returned path.

Pieces hold space marks only at their start, so the lattice of a text is a chain of the lattices
of its segments. Log-sums are found once for each distinct segment of a batch, and all steps run on
arrays of a batch. All randomness is a hash of the row's key, the path's number and the place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame, functions as F, types as T

from wareseek.llm.common import mixed
from wareseek.llm.token_counts import SEGMENT, SPACE_MARK

_CHARS_IN_BATCH = 3 << 18
_COMMON = 160
_LONGEST = 16
_SHORT = 8
_UNIT = float(1 << 32)
_NONE = np.float64(-np.inf)


class Vocabulary:
    """The pieces as tables for array lookups, and the bytes they stand for."""

    def __init__(self, model_file: str, power: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.bytes = [b"" for _ in range(size)]
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
                self.bytes[i] = bytes([int(names[i][3:5], 16)])
        for i in plain:
            self.bytes[i] = names[i].replace(SPACE_MARK, " ").encode()
        # The same pieces one after the other, for many at a time.
        self.joined = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        ranks = np.arange(1, len(plain) + 1)
        total = np.log((1.0 / ranks).sum())
        self.score = np.full(size + 1, -np.inf, dtype=np.float32)
        self.score[plain] = power * (-np.log(ranks) - total)
        #: Of one byte of a character outside the vocabulary.
        self.byte_score = power * (-np.log(size) - total)
        # A tree of the pieces: dense rows for the most frequent characters, sorted keys for the rest.
        edges: dict[tuple[int, str], int] = {}
        piece_at = [-1]
        for i in plain:
            node = 0
            for c in names[i]:
                node = edges.setdefault((node, c), len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = i
        self.piece_at = np.array(piece_at, dtype=np.int32)
        uses: dict[str, int] = {}
        for _, c in edges:
            uses[c] = uses.get(c, 0) + 1
        common = sorted(uses, key=lambda c: (-uses[c], c))[:_COMMON]
        self.column = np.full(0x110000, _COMMON, dtype=np.uint8)
        self.column[[ord(c) for c in common]] = np.arange(len(common))
        inner = sorted({n for n, _ in edges})
        self.row = np.full(len(piece_at), -1, dtype=np.int32)
        self.row[inner] = np.arange(len(inner))
        self.dense = np.zeros((len(inner), _COMMON), dtype=np.int32)
        rare = []
        for (n, c), to in edges.items():
            at = self.column[ord(c)]
            if at < _COMMON:
                self.dense[self.row[n], at] = to
            else:
                rare.append((n << 21 | ord(c), to))
        rare.sort()
        self.rare_keys = np.array([k for k, _ in rare] or [-1], dtype=np.int64)
        self.rare_nodes = np.array([n for _, n in rare] or [0], dtype=np.int32)

    def follow(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node after a character, 0 where the tree ends."""
        rows, columns = self.row[nodes], self.column[chars]
        found = np.where(rows >= 0, self.dense[rows, np.minimum(columns, _COMMON - 1)], 0)
        other = np.flatnonzero((columns == _COMMON) & (rows >= 0))
        found[other] = 0
        if len(other):
            keys = nodes[other].astype(np.int64) << 21 | chars[other]
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            found[other] = np.where(self.rare_keys[at] == keys, self.rare_nodes[at], 0)
        return found


def _load(model_file: str, power: float) -> Vocabulary:
    key = f"pieces of {model_file} at {power}"
    found = ModelCache.get(key)
    if found is None:
        found = Vocabulary(model_file, power)
        ModelCache.add(key, found)
    return found


class Lattices:
    """The lattices of distinct segments; a node is a place in a segment.

    Nodes are numbered by their distance from the segment's end, and within a distance by the
    segments' sizes, the longest first. Then the nodes that lie so many characters further on, in
    the same segments, are again the first ones of their distance, and log-sums need no lookups.
    """

    def __init__(self, segments: list[str], v: Vocabulary):
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        stops = np.cumsum(sizes)
        n, longest = len(chars), int(sizes.max(initial=0))
        left = np.repeat(stops, sizes) - np.arange(n)
        by_size = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(segments), dtype=np.int64)
        rank[by_size] = np.arange(len(segments))
        # Nodes of each distance, and where their numbers begin; none has distance 0.
        counts = np.searchsorted(-sizes[by_size], -np.arange(longest + 1), side="right")
        self.base = np.concatenate([[0, 0], np.cumsum(counts[1:])])
        node_of = self.base[left] + np.repeat(rank, sizes)
        self.distance = np.repeat(np.arange(1, longest + 1), counts[1:])
        self.size = sizes
        self.start = self.base[sizes] + rank
        # pieces[l - 1, node] is the piece of length l there; characters without one become bytes.
        self.pieces = np.full((_LONGEST, n), -1, dtype=np.int32)
        # Long pieces fit at few places, so most nodes need half of the lengths.
        wide = np.zeros(n, dtype=bool)
        active, nodes = np.arange(n), np.zeros(n, dtype=np.int32)
        for length in range(1, _LONGEST + 1):
            nodes = v.follow(nodes, chars[active + length - 1])
            alive = nodes > 0
            active, nodes = active[alive], nodes[alive]
            ends = v.piece_at[nodes]
            self.pieces[length - 1, node_of[active]] = ends
            if length > _SHORT:
                wide[node_of[active[ends >= 0]]] = True
            more = left[active] > length
            active, nodes = active[more], nodes[more]
        score = np.empty((_SHORT, n), dtype=np.float32)
        for i, row in enumerate(self.pieces[:_SHORT]):
            score[i] = v.score[row]  # the number -1 finds the last entry, which is no piece
        codes = np.empty(n, dtype=np.int64)
        codes[node_of] = chars
        strange = np.flatnonzero(self.pieces[0] < 0)
        if len(strange):
            codes = codes[strange]
            width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            score[0, strange] = width * v.byte_score
            # Bytes of one-byte characters are ids already; others are told by their negative code.
            self.pieces[0, strange] = np.where(width == 1, v.byte_ids[np.minimum(codes, 255)], -2 - codes)
        # Log-sums of all paths from a node to its segment's end, from the end backwards, and from
        # them each edge's share of its node.
        sums = [np.zeros(len(segments))]
        share = np.zeros((_LONGEST, n), dtype=np.float32)
        wide_nodes = np.flatnonzero(wide)
        wide_from = np.searchsorted(wide_nodes, self.base[1:])
        for distance in range(1, longest + 1):
            lo, hi = self.base[distance], self.base[distance + 1]
            lengths = range(1, min(distance, _SHORT) + 1)
            reach = np.stack([score[i - 1, lo:hi] + sums[distance - i][: hi - lo] for i in lengths])
            total, share[: len(lengths), lo:hi] = _normal(reach)
            some = wide_nodes[wide_from[distance - 1] : wide_from[distance]]
            if len(some):
                lengths = range(1, min(distance, _LONGEST) + 1)
                fitting = [score[i - 1, some] if i <= _SHORT else v.score[self.pieces[i - 1, some]] for i in lengths]
                reach = np.stack([s + sums[distance - i][some - lo] for i, s in zip(lengths, fitting)])
                total[some - lo], share[: len(lengths), some] = _normal(reach)
            sums.append(total)
        # Read node by node from here on, so a node's edges lie together.
        self.share = np.ascontiguousarray(share.T)
        for i in range(1, _LONGEST):
            share[i] += share[i - 1]
        share[-1] = 2.0  # the last fitting piece takes what rounding leaves over
        self.upto = np.ascontiguousarray(share.T)

    def draw(self, nodes: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of a drawn edge of each node, and the edge's share."""
        chosen = (self.upto[nodes] > uniform[:, None].astype(np.float32)).argmax(1)
        share = self.share[nodes, chosen]
        beyond = np.flatnonzero(share == 0)
        if len(beyond):
            chosen[beyond] = _LONGEST - 1 - (self.share[nodes[beyond], ::-1] > 0).argmax(1)
            share[beyond] = self.share[nodes[beyond], chosen[beyond]]
        return chosen, share

    def after(self, nodes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes at the ends of edges, and whether those are not yet their segments' ends."""
        here = self.distance[nodes]
        there = here - edges - 1
        return self.base[there] + nodes - self.base[here], there > 0


def _normal(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sums over the first axis, and each entry's share of its sum."""
    top = reach.max(0)
    weight = np.exp((reach - top).astype(np.float32))
    total = weight.sum(0)
    return top + np.log(total), weight / total


def _uniform(keys: np.ndarray, number: int, place: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 that depend on the row, the path and the place alone."""
    x = mixed(keys + np.uint64((number * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    x = mixed(x ^ (place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _below(location: np.ndarray, bound: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Gumbel numbers at a location, none larger than their bound."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        drawn = location - np.log(np.exp(np.minimum(location - bound, 700.0)) - np.log(uniform))
    return np.where(np.isneginf(location), _NONE, np.minimum(drawn, bound))


@dataclass
class Paths:
    """One path for each document of a batch, token after token, documents one after the other."""

    offset: np.ndarray  # of each document's first token, and the end
    place: np.ndarray  # of the token's segment among all occurrences
    node: np.ndarray
    edge: np.ndarray
    share: np.ndarray  # of the edge among those of its node
    mass: np.ndarray  # log-probability of the path up to the token
    after: np.ndarray  # and with it


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, joined."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else starts
    return np.arange(total) + shift


class Batch:
    """The search over one batch of texts, all documents side by side."""

    def __init__(self, texts: list[str], keys: np.ndarray, v: Vocabulary):
        known: dict[str, int] = defaultdict(count().__next__)
        ids, counts = [], []
        for text in texts:
            found = SEGMENT.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []
            ids += map(known.__getitem__, found)
            counts.append(len(found))
        self.keys = keys
        self.docs = len(texts)
        self.lattices = Lattices(list(known), v)
        self.segment = np.array(ids, dtype=np.int64)
        self.segments_of = np.array(counts, dtype=np.int64)
        self.doc = np.repeat(np.arange(self.docs), self.segments_of)
        self.first = np.cumsum(self.segments_of) - self.segments_of
        sizes = self.lattices.size[self.segment] if len(self.segment) else self.segment
        # Where each segment begins in its document.
        ends = np.cumsum(sizes)
        begins = ends - sizes
        base = begins[np.minimum(self.first, max(len(begins) - 1, 0))] if len(begins) else self.first
        self.begin = begins - np.repeat(base, self.segments_of)

    def _walk(self, place: np.ndarray, node: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
        """Draws the rest of each given segment occurrence, from a node on. Tokens come in order."""
        lat = self.lattices
        which = np.arange(len(place))
        steps = []
        while len(which):
            where = place[which]
            at = self.begin[where] + lat.size[self.segment[where]] - lat.distance[node]
            edge, share = lat.draw(node, _uniform(self.keys[self.doc[where]], number, at))
            steps.append((which, node, edge, share))
            node, more = lat.after(node, edge)
            which, node = which[more], node[more]
        if not steps:
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, empty, np.empty(0, dtype=np.float32)
        count = np.bincount(np.concatenate([s[0] for s in steps]), minlength=len(place))
        begin = np.cumsum(count) - count
        nodes, edges = np.empty(int(count.sum()), dtype=np.int64), np.empty(int(count.sum()), dtype=np.int64)
        shares = np.empty(len(edges), dtype=np.float32)
        for i, (which, node, edge, share) in enumerate(steps):
            to = begin[which] + i
            nodes[to], edges[to], shares[to] = node, edge, share
        return np.repeat(place, count), nodes, edges, shares

    def _finish(self, docs: np.ndarray, place: np.ndarray, node: np.ndarray, edge: np.ndarray, share: np.ndarray) -> Paths:
        """Adds up log-probabilities; ``docs`` has the tokens of each document.

        They are added as whole numbers of a fine unit, so that a document's sums are the same in
        every batch.
        """
        with np.errstate(divide="ignore"):
            step = np.log(share.astype(np.float64))
        offset = np.concatenate([[0], np.cumsum(docs)])
        whole = np.concatenate([[0], np.cumsum(np.rint(step * _UNIT).astype(np.int64))])
        before = np.repeat(whole[offset[:-1]], docs)
        return Paths(offset, place, node, edge, share, (whole[:-1] - before) / _UNIT, (whole[1:] - before) / _UNIT)

    def first_paths(self) -> Paths:
        place = np.arange(len(self.segment))
        found = self._walk(place, self.lattices.start[self.segment] if len(place) else place, 0)
        return self._finish(np.bincount(self.doc[found[0]], minlength=self.docs), *found)

    def waiting(self, paths: Paths, since: np.ndarray, taken: np.ndarray, bound: np.ndarray, number: int) -> np.ndarray:
        """Noisy maxima of what each token's node leaves open.

        ``since`` is each document's first token to look at, ``taken`` the edges of that token's
        node that are already on a path, as bits.
        """
        sizes = np.diff(paths.offset)
        doc = np.repeat(np.arange(self.docs), sizes)
        token = np.arange(len(doc)) - paths.offset[doc]
        lat = self.lattices
        late = np.flatnonzero(token >= since[doc])
        doc, token, node, edge = doc[late], token[late], paths.node[late], paths.edge[late]
        # What a node's other edges weigh, summed without the path's own, so small rests stay exact.
        rest = 1.0 - paths.share[late].astype(np.float64)
        small = np.flatnonzero(rest < 0.1)
        others = lat.share[node[small]]
        others[np.arange(len(small)), edge[small]] = 0
        rest[small] = np.einsum("ij->i", others, dtype=np.float64)
        branch = np.flatnonzero((since < sizes) & (taken > 0))
        at = np.searchsorted(late, paths.offset[branch] + since[branch])
        used = (taken[branch][:, None] >> np.arange(_LONGEST)) & 1
        rest[at] = (lat.share[node[at]] * (used == 0)).sum(1, dtype=np.float64)
        with np.errstate(divide="ignore"):
            location = paths.mass[late] + np.log(rest)
        found = np.full(len(paths.node), _NONE)
        found[late] = _below(location, bound[doc], _uniform(self.keys[doc], 1000 + number, token))
        return found

    def branched(self, paths: list[Paths], path: np.ndarray, token: np.ndarray, edge: np.ndarray, alive: np.ndarray, number: int) -> Paths:
        """New paths: like ``path`` up to ``token``, there by another edge, then drawn anew."""
        kept_place, kept_node, kept_edge, kept_share, kept_doc = [], [], [], [], []
        starts, nodes, docs_of = [], [], []
        for r, old in enumerate(paths):
            mine = np.flatnonzero(alive & (path == r))
            if not len(mine):
                continue
            rows = _ranges(old.offset[mine], token[mine])
            at = old.offset[mine] + token[mine]
            kept_place += [old.place[rows], old.place[at]]
            kept_node += [old.node[rows], old.node[at]]
            kept_edge += [old.edge[rows], edge[mine]]
            kept_share += [old.share[rows], self.lattices.share[old.node[at], edge[mine]]]
            kept_doc += [np.repeat(mine, token[mine]), mine]
            # The rest of the segment after the new edge, and all segments behind it.
            where = old.place[at]
            now, unfinished = self.lattices.after(old.node[at], edge[mine])
            behind = self.first[mine] + self.segments_of[mine] - where - 1
            rest = _ranges(where + 1, behind)
            starts += [where[unfinished], rest]
            nodes += [now[unfinished], self.lattices.start[self.segment[rest]]]
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        place, node = join(starts), join(nodes)
        order = np.argsort(place, kind="stable")
        tail = self._walk(place[order], node[order], number)
        doc = np.concatenate([join(kept_doc), self.doc[tail[0]]])
        parts = [np.concatenate([join(kept), t]) for kept, t in zip((kept_place, kept_node, kept_edge, kept_share), tail)]
        # Kept tokens of a document come before drawn ones, and the changed one last among them.
        order = np.argsort(doc, kind="stable")
        return self._finish(np.bincount(doc, minlength=self.docs), *[p[order] for p in parts])

    def samples(self, k: int):
        """Up to k paths of each document: yields (paths, alive, perturbed) and at last the threshold."""
        everyone = np.ones(self.docs, dtype=bool)
        bound = -np.log(-np.log(_uniform(self.keys, 999, np.zeros(self.docs, dtype=np.int64))))
        paths = [self.first_paths()]
        found = [(paths[0], everyone, bound)]
        value = np.full((self.docs, 2 * k), _NONE)
        origin, token, taken = (np.zeros((self.docs, 2 * k), dtype=np.int64) for _ in range(3))
        since, bits = np.zeros(self.docs, dtype=np.int64), np.zeros(self.docs, dtype=np.int64)
        alive = everyone
        for number in range(k):
            current = paths[-1]
            self._enter(current, number, alive, since, bits, bound, value, origin, token, taken, k)
            best = value.argmax(1)
            rows = np.arange(self.docs)
            top = value[rows, best]
            if number == k - 1:
                return found, top
            alive = top > _NONE
            path, at, used = origin[rows, best], token[rows, best], taken[rows, best]
            value[rows, best] = _NONE
            node = np.zeros(self.docs, dtype=np.int64)
            for r, old in enumerate(paths):
                mine = np.flatnonzero(alive & (path == r))
                node[mine] = old.node[old.offset[mine] + at[mine]]
            edge = np.zeros(self.docs, dtype=np.int64)
            mine = np.flatnonzero(alive)
            if len(mine):
                open_ = ((used[mine][:, None] >> np.arange(_LONGEST)) & 1) == 0
                share = self.lattices.share[node[mine]].astype(np.float64) * open_
                upto = np.cumsum(share, axis=1)
                u = _uniform(self.keys[mine], 2000 + number, at[mine]) * upto[:, -1]
                edge[mine] = np.minimum((upto <= u[:, None]).sum(1), _LONGEST - 1 - (share > 0)[:, ::-1].argmax(1))
            paths.append(self.branched(paths, path, at, edge, alive, number + 1))
            since, bits = at, used | np.where(alive, 1 << edge, 0)
            bound = np.where(alive, top, _NONE)
            found.append((paths[-1], alive, bound))
        return found, np.full(self.docs, _NONE)

    def _enter(self, paths, number, alive, since, bits, bound, value, origin, token, taken, k) -> None:
        """Puts the k largest open nodes of new paths onto the frontier, whose k largest stay."""
        if number == 0:
            bits = np.zeros(self.docs, dtype=np.int64)
        open_ = self.waiting(paths, since, bits, np.where(alive, bound, 0.0), number)
        sizes = np.diff(paths.offset)
        filled = np.flatnonzero(sizes > 0)
        order = np.argsort(-value, axis=1, kind="stable")
        for part in (value, origin, token, taken):
            part[:] = np.take_along_axis(part, order, 1)
        for i in range(k):
            column = k + i
            value[:, column] = _NONE
            if not len(filled):
                continue
            top = np.maximum.reduceat(open_, paths.offset[filled])
            first = np.full(self.docs, 0, dtype=np.int64)
            hit = np.flatnonzero(open_ == np.repeat(top, sizes[filled]))
            doc = np.searchsorted(paths.offset, hit, side="right") - 1
            docs, at = np.unique(doc, return_index=True)
            first[docs] = hit[at]
            value[filled, column] = top
            origin[:, column] = number
            token[:, column] = first - paths.offset[:-1]
            own = np.zeros(self.docs, dtype=np.int64)
            own[filled] = 1 << paths.edge[first[filled]]
            taken[:, column] = np.where(token[:, column] == since, own | bits, own)
            open_[first[filled]] = _NONE

    def ids(self, paths: Paths, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all tokens and the number of each document; strange characters as bytes."""
        made = self.lattices.pieces[paths.edge, paths.node] if len(paths.node) else np.empty(0, dtype=np.int32)
        sizes = np.diff(paths.offset)
        if not (made < 0).any():
            return made, sizes
        codes = np.where(made < 0, -2 - made, 0)
        width = np.where(made < 0, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), 1)
        out = np.repeat(made, width)
        at = np.cumsum(width) - width
        for i in np.flatnonzero(made < 0):
            out[at[i] : at[i] + width[i]] = v.byte_ids[list(chr(codes[i]).encode())]
        doc = np.repeat(np.arange(self.docs), sizes)
        return out, np.bincount(doc, weights=width, minlength=self.docs).astype(np.int64)


def log_inclusion(log_prob: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Log of the chance that a path of this log-probability lies above the threshold."""
    gap = log_prob - threshold
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        exact = np.log(-np.expm1(-np.exp(np.minimum(gap, 700.0))))
    return np.where(np.isneginf(threshold), 0.0, np.where(gap < -30, gap, exact))


_NAMES = ("sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids")


def _rows(texts: list[str], keys: np.ndarray, k: int, v: Vocabulary):
    """Arrays of all samples of a batch: the row they belong to, then the columns of ``_NAMES``."""
    batch = Batch(texts, keys, v)
    found, threshold = batch.samples(k)
    columns: list[list] = [[] for _ in range(7)]
    for number, (paths, alive, perturbed) in enumerate(found):
        mine = np.flatnonzero(alive)
        ids, counts = batch.ids(paths, v)
        total = np.zeros(batch.docs)
        full = np.diff(paths.offset) > 0
        total[full] = paths.after[paths.offset[1:][full] - 1]
        for column, part in zip(
            columns,
            (mine, np.full(len(mine), number), counts[mine], total[mine], perturbed[mine], log_inclusion(total, threshold)[mine]),
        ):
            column.append(part)
        columns[6].append(ids)
    return [np.concatenate(c) for c in columns]


def _sampled(
    batches: Iterator[pa.RecordBatch], model_file: str, power: float, k: int, text: str, key: str, read_back: str | None, most_chars: int
) -> Iterator[pa.RecordBatch]:
    v = _load(model_file, power)

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in rows.column(text).to_pylist()]
        keys = rows.column(key).to_numpy().astype(np.int64).view(np.uint64)
        row, *numbers, ids = _rows(texts, keys, k, v)
        offsets = np.concatenate([[0], np.cumsum(numbers[1])]).astype(np.int32)
        names = [n for n in rows.schema.names if n not in (text, key)]
        take = pa.array(row)
        arrays = [rows.column(n).take(take) for n in names]
        arrays += [pa.array(numbers[0].astype(np.int32)), pa.array(numbers[1].astype(np.int64)), *map(pa.array, numbers[2:])]
        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
        if read_back is None:
            return pa.RecordBatch.from_arrays(arrays, [*names, *_NAMES])
        arrays.append(pa.array(all_decoded(ids, offsets, v), pa.string()))
        return pa.RecordBatch.from_arrays(arrays, [*names, *_NAMES, read_back])

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy())
        start = 0
        while start < batch.num_rows:  # whole texts, as many as fit, one at least
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most_chars, side="right")))
            yield done(batch.slice(start, end - start))
            start = end


def sample_pieces(
    docs: DataFrame,
    model_file: str,
    k: int,
    text: str = "text",
    key: str = "doc_id",
    seed: int = 11,
    power: float = 1.0,
    read_back: str | None = None,
    batch_chars: int = _CHARS_IN_BATCH,
) -> DataFrame:
    """Up to ``k`` distinct segmentations of every text: a row each, the text left out.

    Adds ``sample`` (from 0, the largest perturbed score first), ``n_pieces``, ``log_prob`` (of
    the segmentation among all of its text), ``perturbed``, ``log_inclusion`` (the log-chance of
    such a segmentation to be among the k, given the threshold that the next one sets) and
    ``ids``. Characters outside the vocabulary are byte pieces.

    A null or empty text has one segmentation, the empty one; a text with fewer than k
    segmentations gives all of them. The draw depends on the key, the text and ``seed`` alone, so
    repeated rows get equal samples; ``read_back`` names a further column with the text decoded
    from the ids, in the same pass; null keys share one seed. Columns of ``docs`` with the names
    of added ones are replaced. An empty table gives no rows.

    ``batch_chars`` sets how many characters are worked on at once, whole texts and one at least. It
    changes no sample: more share the work on repeated segments, fewer need less memory.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, read_back, *_NAMES)]
    schema = T.StructType(
        [
            *kept,
            T.StructField("sample", T.IntegerType()),
            T.StructField("n_pieces", T.LongType()),
            *[T.StructField(n, T.DoubleType()) for n in _NAMES[2:5]],
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            *([] if read_back is None else [T.StructField(read_back, T.StringType())]),
        ]
    )
    seeded = docs.select(*[f.name for f in kept], F.col(text), F.xxhash64(F.lit(seed), F.col(key)).alias("_seed"))
    return seeded.mapInArrow(lambda b: _sampled(b, model_file, power, k, text, "_seed", read_back, batch_chars), schema)


def decoded(ids: list[int], v: Vocabulary) -> str:
    """The text that pieces stand for. A space mark in the text comes back as a space."""
    joined = b"".join(map(v.bytes.__getitem__, ids)).decode("utf-8", "replace")
    return joined[1:] if joined.startswith(" ") else joined


def all_decoded(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[str]:
    """``decoded`` for many lists of ids, which lie one after the other."""
    sizes = v.sizes[ids]
    ends = np.cumsum(sizes)
    joined = v.joined[np.repeat(v.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    cuts = np.concatenate([[0], ends])[offsets].tolist()
    texts = (joined[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:]))
    return [t[1:] if t.startswith(" ") else t for t in texts]


def _decode(batches: Iterator[pa.RecordBatch], model_file: str, ids: str, name: str) -> Iterator[pa.RecordBatch]:
    v = _load(model_file, 1.0)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            values = part.column(ids)
            offsets = np.concatenate([[0], np.cumsum(values.value_lengths().fill_null(0).to_numpy())])
            texts = all_decoded(values.flatten().to_numpy(), offsets, v)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])


def decode_pieces(rows: DataFrame, model_file: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; the name can be chosen where it would clash. Null ids are empty."""
    if name in rows.columns:
        raise ValueError(f"column {name} exists already; choose another name")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    return rows.mapInArrow(lambda b: _decode(b, model_file, ids, name), schema)

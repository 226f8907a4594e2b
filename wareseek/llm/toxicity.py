"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The field has two states, clean and toxic. It is trained here from document labels: features
(words and their beginnings) label the tokens of a bounded sample's toxic documents, each as far
as its counts in both classes speak of toxicity, and the field learns from those sequences how
strongly each feature speaks and how toxic tokens follow each other. Forward-backward gives every token's marginal, marginals above
one half are offending spans, and a document's score is the calibrated chance that any token is
toxic.

Only few words carry a feature. The words between two of them share one transition matrix, so a
run of k neutral words is its k-th power, and a text costs one lookup for each word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wareseek.llm.common import slices

_TOKEN = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7, 8)
_ROWS = 256
#: Windows that training looks at together; any number of such groups is gone through.
_WINDOWS = 5_000
_KNOWN_WORDS = 300_000
_POWERS = 64


def features_of(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in _PREFIXES if len(word) >= n)]


@dataclass(frozen=True)
class Training:
    """What the model is fitted on. The sample is bounded: the labelled rows of each class that
    come first in the order of a hash of their id, ``docs_per_class`` at most. All windows of these
    rows that hold a feature train the field.

    ``prior`` are the odds, before any count, that a feature tells the classes apart; a higher
    ``sharpness`` trusts features less that clean documents hold too. Both are odds and rates, so
    they mean the same for a sample of any size."""

    docs_per_class: int = 2000
    prior: float = 3e-4
    sharpness: float = 8.0
    least: float = 0.1
    window: int = 40
    rounds: int = 80
    rate: float = 0.1
    penalty: float = 1e-4


@dataclass
class Field:
    """Log-potentials: of features on the toxic state, of the toxic state itself, of transitions."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    offset: float = 0.0

    def emission(self, word: str) -> float | None:
        """The weight of a lower-case word, None for a neutral one."""
        found = [self.weights[f] for f in features_of(word) if f in self.weights]
        return sum(found) if found else None


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def telling(toxic: int, clean: int, n_toxic: int, n_clean: int, t: Training) -> float:
    """How far, from 0 to 1, a feature's occurrences in toxic documents speak of toxicity.

    The chance that the two classes hold the feature at rates of their own, by the evidence of the
    counts against one common rate, times the part of its rate in toxic documents that clean
    ones do not explain. Few counts or some wrong labels lower the number and rule nothing out.
    """
    rate = [(toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)]
    if rate[0] <= rate[1]:
        return 0.0
    apart = _log_beta(toxic + 0.5, n_toxic - toxic + 0.5) + _log_beta(clean + 0.5, n_clean - clean + 0.5)
    common = _log_beta(toxic + clean + 0.5, n_toxic + n_clean - toxic - clean + 0.5) + _log_beta(0.5, 0.5)
    odds = math.log(t.prior) + apart - common
    return (1 - rate[1] / rate[0]) ** t.sharpness / (1 + math.exp(-min(odds, 500.0)))


def _label_features(docs: list[tuple[list[str], int]], t: Training) -> dict[str, float]:
    """Features of the sample's toxic documents with how telling each is.

    Copies of a document are no further evidence, so a feature counts at most once for each pair
    of words around it. Those below ``least`` would move no token's label and are left out.
    """
    held = (Counter(), Counter())
    n = [0, 0]
    for words, toxic in docs:
        n[toxic] += 1
        held[toxic].update({f for w in set(words) for f in features_of(w)})
    clean, toxic = held
    cache: dict[tuple[int, int], float] = {}

    def strength(feature: str, c: int) -> float:
        pair = (c, clean[feature])
        if pair not in cache:
            cache[pair] = telling(*pair, n[1], n[0], t)
        return cache[pair]

    likely = {f for f, c in toxic.items() if strength(f, c) >= t.least}
    around: dict[str, set] = {f: set() for f in likely}
    known: dict[str, list[str]] = {}
    for words, is_toxic in docs:
        if is_toxic:
            for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                found = known.get(w)
                if found is None:
                    found = known[w] = [f for f in features_of(w) if f in likely]
                for f in found:
                    around[f].add((before, after))
    found = {f: strength(f, min(toxic[f], len(around[f]))) for f in likely}
    return {f: q for f, q in found.items() if q >= t.least}


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, counted: np.ndarray):
    """Marginals of state 1, and summed over ``counted`` rows those of state pairs.

    Takes rows of padded emissions of state 1.
    """
    n, size = emissions.shape
    potential = np.exp(transitions)
    alpha = np.zeros((size, n, 2))
    beta = np.ones((size, n, 2))
    e = np.stack([np.zeros_like(emissions), emissions], 2)
    e = np.exp(e - e.max(2, keepdims=True))
    alpha[0] = e[:, 0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for i in range(1, size):
        alpha[i] = (alpha[i - 1] @ potential) * e[:, i]
        alpha[i] /= alpha[i].sum(1, keepdims=True)
    for i in range(size - 2, -1, -1):
        inside = (i + 1 < lengths)[:, None]
        moved = (beta[i + 1] * e[:, i + 1]) @ potential.T
        beta[i] = np.where(inside, moved / moved.sum(1, keepdims=True), 1.0)
    joint = alpha * beta
    joint /= joint.sum(2, keepdims=True)
    pairs = np.zeros((2, 2))
    for i in range(1, size):
        both = alpha[i - 1][:, :, None] * potential * (beta[i] * e[:, i])[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        pairs += (both * ((i < lengths) & counted)[:, None, None]).sum(0)
    return joint[:, :, 1].T, pairs


def fit(rows: list[tuple[str, int]], t: Training = Training()) -> Field:
    """Fits a field to (text, label) rows. Without both labels no word is ever toxic."""
    model = Field()
    tokens = [[w.lower() for w in _TOKEN.findall(text)] for text, _ in rows]
    labels = [label for _, label in rows]
    if len(set(labels)) < 2:
        model.offset = -4.0
        return model
    strength = _label_features(list(zip(tokens, labels)), t)
    chosen = sorted(strength)
    place = {f: i for i, f in enumerate(chosen)}
    known: dict[str, list[int]] = {}
    # Windows of the token sequences; those without any feature are all alike and counted once.
    feature_rows, feature_ids, truth, sizes = [], [], [], []
    plain = 0
    for words, toxic in zip(tokens, labels):
        for at in range(0, len(words), t.window):
            part = words[at : at + t.window]
            found = []
            for w in part:
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = [place[f] for f in features_of(w) if f in place]
                found.append(ids)
            if not any(found):
                plain += 1
                continue
            row = len(sizes)
            sizes.append(len(part))
            told = [max((strength[chosen[j]] for j in ids), default=0.0) if toxic else 0.0 for ids in found]
            truth.append(told + [0.0] * (t.window - len(part)))
            for i, ids in enumerate(found):
                feature_rows += [row * t.window + i] * len(ids)
                feature_ids += ids
    n = len(sizes) + 1
    sizes = np.array([*sizes, t.window])
    truth = np.array([*truth, [0.0] * t.window]).reshape(n, t.window)
    count = np.ones(n)
    count[-1] = max(plain, 1)
    where, which = np.array(feature_rows, dtype=np.int64), np.array(feature_ids, dtype=np.int64)
    inside = np.arange(t.window) < sizes[:, None]
    times = inside * count[:, None]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            first, second = (truth if x else 1 - truth for x in (a, b))
            seen[a, b] = (first[:, :-1] * second[:, 1:] * inside[:, 1:])[:-1].sum()
    weights, bias, moves = np.zeros(len(chosen)), -4.0, np.zeros((2, 2))
    held = np.bincount(which, minlength=len(chosen)).astype(float) + 1
    state = [np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0, np.zeros((2, 2)), np.zeros((2, 2))]
    total = times.sum()
    # The window that stands for all plain ones tells the bias only; transitions learn from the rest.
    learns = np.arange(n) < n - 1
    for step in range(1, t.rounds + 1):
        emissions = bias + np.bincount(where, weights[which], n * t.window).reshape(n, t.window)
        marginal, pairs = np.empty_like(emissions), np.zeros((2, 2))
        for at in range(0, n, _WINDOWS):
            part = slice(at, at + _WINDOWS)
            marginal[part], more = forward_backward(emissions[part], sizes[part], moves, learns[part])
            pairs += more
        miss = (truth - marginal) * inside
        gradients = (
            np.bincount(which, miss.reshape(-1)[where], len(chosen)) / held - t.penalty * weights,
            float((miss * times).sum()) / total * 50,
            (seen - pairs) / max(seen.sum(), 1) - t.penalty * moves,
        )
        updated = []
        for i, (value, gradient) in enumerate(zip((weights, bias, moves), gradients)):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * gradient
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * np.square(gradient)
            mean, spread = state[2 * i] / (1 - 0.9**step), state[2 * i + 1] / (1 - 0.99**step)
            updated.append(value + t.rate * mean / (np.sqrt(spread) + 1e-8))
        weights, bias, moves = updated
    model.weights = {f: float(w) for f, w in zip(chosen, weights)}
    model.bias, model.transitions = float(bias), moves
    chain = Chain(model)
    raw = np.array([chain.evidence([m for m, *_ in chain.marginals(text)]) for text, _ in rows])
    y = np.array(labels, dtype=float)
    # One-dimensional logistic regression, pulled to its start so that separable data stay finite.
    begin = np.array([0.0, 1.0])
    beta = begin
    x = np.stack([np.ones_like(raw), raw], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - 2.0 * (beta - begin)
        hessian = (x * (p * (1 - p) + 0.01)[:, None]).T @ x + 2.0 * np.eye(2)
        beta = np.clip(beta + np.linalg.solve(hessian, gradient), [-20.0, 0.05], [20.0, 5.0])
    model.offset, model.slope = float(beta[0]), float(beta[1])
    return model


class Chain:
    """A field made ready to tag texts."""

    def __init__(self, model: Field):
        self.model = model
        self._known: dict[str, float | None] = {}
        step = np.exp(model.transitions) * np.exp([0.0, model.bias])
        power = np.eye(2)
        self._powers = []
        for _ in range(_POWERS + 1):
            self._powers.append(power / power.sum())
            power = power @ step
            power /= power.sum()

    def emissions(self, words: list[str]) -> list[float | None]:
        known = self._known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.model.emission(w.lower())
            return [known[w] for w in words]

    def marginals(self, text: str) -> list[tuple[float, int, int]]:
        """For each word with a feature: its marginal of being toxic, its start and its end."""
        if not self.model.weights:
            return []
        emissions = self.emissions(_TOKEN.findall(text))
        at = [i for i, e in enumerate(emissions) if e is not None]
        if not at:
            return []
        bias = self.model.bias
        moves = np.exp(self.model.transitions)
        # Runs longer than the table have the same direction to machine precision.
        power = [self._powers[min(k, _POWERS)] for k in np.diff([0, *at]) - 1]
        tail = self._powers[min(len(emissions) - 1 - at[-1], _POWERS)]
        local = [np.array([1.0, np.exp(min(emissions[i] + bias, 500.0))]) for i in at]
        local = [v / v.sum() for v in local]
        # No transition leads into the first word; powers hold the one into each word of a run, and
        # the one into this word follows.
        forward, now = [], np.array([1.0, np.exp(bias)])
        for i, (gap, v) in enumerate(zip(power, local)):
            now = (now @ gap @ moves if i or at[0] else np.ones(2)) * v
            now /= now.sum()
            forward.append(now)
        back = tail @ np.ones(2)
        found = []
        for i in range(len(at) - 1, -1, -1):
            joint = forward[i] * back
            found.append(joint[1] / joint.sum())
            back = power[i] @ moves @ (local[i] * back)
            back /= back.sum()
        found.reverse()
        spans = [m.span() for m in _TOKEN.finditer(text)]
        return [(float(p), *spans[i]) for p, i in zip(found, at)]

    @staticmethod
    def evidence(marginals: list[float]) -> float:
        """Log-odds that any word is toxic, the words' marginals taken as independent."""
        log_none = float(np.log1p(-np.clip(marginals, 0, 1 - 1e-9)).sum()) if marginals else 0.0
        log_none = min(log_none, -1e-4)
        return float(np.clip(np.log(-np.expm1(log_none)) - log_none, -9.0, 9.0))

    def score(self, marginals: list[float]) -> float:
        x = self.model.offset + self.model.slope * self.evidence(marginals)
        return float(1 / (1 + np.exp(-x)))


def sample(docs: DataFrame, labels: DataFrame, t: Training, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """The bounded training sample: (text, label) of labelled rows outside the held-out fifth."""
    once = (
        labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key))
        .groupBy(key)
        .agg((F.max("toxic") > 0).cast("int").alias("_label"))
    )
    order = (F.xxhash64(F.col(key)), F.col(key))
    ids = [once.where(F.col("_label") == y).orderBy(*order).limit(t.docs_per_class) for y in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))  # at most twice docs_per_class ids
    found = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(chosen, key)
    return [(r["_text"], r["_label"]) for r in found.dropDuplicates([key]).orderBy(key).collect()]


def held_out(key: str = "doc_id"):
    """Whether a document belongs to the fifth that is never trained on."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def _tagged(
    batches: Iterator[pa.RecordBatch], model: Field, text: str, names: tuple[str, ...], kept: list[str]
) -> Iterator[pa.RecordBatch]:
    chain = Chain(model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches, _ROWS):
        scores, spans = [], []
        for whole in batch.column(text).to_pylist():
            found = chain.marginals(whole) if whole else []
            scores.append(chain.score([p for p, *_ in found]))
            spans.append([{"start": s, "end": e} for p, s, e in found if p >= 0.5])
        made = [pa.array(scores, pa.float64()), pa.array(spans, spans_type)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *made], [*kept, *names])


def tag(
    docs: DataFrame,
    model: Field,
    text: str = "text",
    score: str = "score",
    spans: str = "toxic_spans",
    drop: Sequence[str] = (),
) -> DataFrame:
    """Adds a score from 0 to 1 and the offending spans (code points, end exclusive) to each row.

    A null or empty text, or one without a telling word, gets the score of no evidence. Rows are
    scored one by one, so repeated rows and empty tables need no care; other columns pass
    unchanged, and the names of the added ones can be chosen where they would clash. Columns in ``drop``
    are not passed on: a text that nobody reads afterwards need not travel back from the tasks' Python.
    """
    if {score, spans} & set(docs.columns):
        raise ValueError(f"columns {score} or {spans} exist already; choose other names")
    kept = [f for f in docs.schema.fields if f.name not in drop]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*kept, T.StructField(score, T.DoubleType()), T.StructField(spans, T.ArrayType(span))])
    names = [f.name for f in kept]
    return docs.mapInArrow(lambda batches: _tagged(batches, model, text, (score, spans), names), schema)

"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are tagged 0 or 1. Features of a word: the word and its prefixes, lower-cased and stripped of punctuation. The
labels are per document, so tags are latent: training first finds the features that mark toxic documents (by document frequency), tags
the words of toxic documents that have one, and then fits the field to those tags by gradient ascent on the
conditional likelihood. Forward-backward marginals of the words with evidence give spans; their sum and maximum give
the document's score through a logistic model fitted on the same sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model is fitted on at most so many labelled documents of either class, those with the smallest hash of doc_id.
SAMPLE = 1500
#: A document is predicted toxic from this score on.
CUT = 0.7
_PREFIXES = range(3, 8)
_WINDOW = 32
_CACHE = 300_000
_NOT_BLANK = re.compile(r"\S+")  # as str.split() cuts
_EDGE = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[str]:
    """The word and its proper prefixes of 3 to 7 characters; none for a word without letters or digits."""
    word = _EDGE.sub("", word.lower())
    return [f"={word}", *(f"^{word[:k]}" for k in _PREFIXES if k < len(word))] if word else []


@dataclass
class Field:
    """weights: of the features for tag 1; bias: of tag 1; moves: transition scores [from, to]."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: np.ndarray = field(default_factory=lambda: np.array([-5.0, 0.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def marginals(model: Field, at: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Probability of tag 1 at positions `at` of n words, whose emissions are `scores`; elsewhere the emission is the bias.

    Exact: a run of words without evidence is one power of the same 2 by 2 matrix, taken by its eigenvectors.
    """
    move = np.exp(model.moves)
    quiet = move * np.array([1.0, math.exp(model.bias)])
    values, vectors = np.linalg.eig(quiet)
    order = np.argsort(-values.real)
    values, vectors = values.real[order], vectors.real[:, order]
    inverse, ratio = np.linalg.inv(vectors), values[1] / values[0]

    def run(k: int) -> np.ndarray:
        return (vectors * np.array([1.0, ratio**k])) @ inverse

    emit = np.stack([np.ones(len(at)), np.exp(np.minimum(scores, 60))], 1)
    start = np.array([1.0, math.exp(model.bias)])
    gaps = np.diff(at) - 1
    between = [move * e if g == 0 else run(int(g)) @ move * e for g, e in zip(gaps, emit[1:])]
    forward = np.empty((len(at), 2))
    state = emit[0] if at[0] == 0 else (start @ run(int(at[0]) - 1)) @ move * emit[0]
    forward[0] = state / state.sum()
    for k, step in enumerate(between):
        state = forward[k] @ step
        forward[k + 1] = state / state.sum()
    backward = np.empty_like(forward)
    backward[-1] = run(n - 1 - int(at[-1])) @ np.ones(2) if at[-1] < n - 1 else 1.0
    for k in range(len(between) - 1, -1, -1):
        state = between[k] @ backward[k + 1]
        backward[k] = state / state.sum()
    both = np.maximum(forward * backward, 0)
    return both[:, 1] / both.sum(1)


def _evidence(documents: list[list[str]], toxic: np.ndarray, words: dict[str, list[str]]) -> set[str]:
    """Features that toxic documents hold, or hold more than once, far more often than others do."""
    seen = {(least, label): Counter() for least in (1, 2) for label in (0, 1)}
    for tokens, label in zip(documents, toxic):
        found = Counter()
        for w, c in Counter(tokens).items():
            for f in words[w]:
                found[f] += c
        seen[1, int(label)].update(found.keys())
        seen[2, int(label)].update(f for f, c in found.items() if c > 1)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    kept = set()
    for least in (1, 2):
        for f, c in seen[least, 1].items():
            odds = math.log((c + 0.5) / (n1 + 1)) - math.log((seen[least, 0][f] + 0.5) / (n0 + 1))
            if c >= 2 and odds > 2.5 and odds * math.sqrt(c) > 7.5:
                kept.add(f)
    return kept


def fit(texts: list[str], toxic: np.ndarray, steps: int = 100, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """The field and the logistic model. Without documents of both classes, every score is near 0."""
    model = Field()
    toxic = np.asarray(toxic, dtype=float)
    if not len(texts) or toxic.min() == toxic.max():
        return model
    documents = [t.split() for t in texts]
    words = {w: features(w) for w in set().union(*documents)}
    kept = sorted(_evidence(documents, toxic, words))
    if not kept:
        return model
    number = {f: k for k, f in enumerate(kept)}
    marked = {w: [number[f] for f in fs if f in number] for w, fs in words.items()}
    tokens, tags, places, n = [], [], [], 0
    for document, label in zip(documents, toxic):  # each document begins a window of its own: no transition joins two
        has = [marked[w] for w in document]
        tokens += has
        tags += [int(bool(h) and label > 0) for h in has]
        places.append(np.arange(n, n + len(has)))
        n += -(-len(has) // _WINDOW) * _WINDOW
    at = np.concatenate([*places, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    y, real = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    y[at], real[at] = tags, True
    row = np.repeat(at, [len(h) for h in tokens])
    column = np.array([c for h in tokens for c in h], dtype=np.int64)
    y, real = y.reshape(-1, _WINDOW), real.reshape(-1, _WINDOW)
    some = np.zeros(n, dtype=bool)
    some[row] = True
    use = some.reshape(-1, _WINDOW).any(1) | ~real.all(1)
    plain = np.flatnonzero(~use)  # windows without evidence are all alike: one stands for all of them
    weight = np.ones(len(use))
    if len(plain):
        use[plain[0]], weight[plain[0]] = True, len(plain)
    weight = weight[use]
    w, bias, moves = np.zeros(len(kept)), -4.0, np.zeros((2, 2))
    total = max(1, real.sum())
    squares = [np.full(len(kept), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(steps):  # full gradients, AdaGrad
        e = np.full(n, bias)
        np.add.at(e, row, w[column])
        e = np.minimum(e.reshape(-1, _WINDOW)[use], 30)
        emit = np.stack([np.ones_like(e), np.exp(e)], -1)
        move = np.exp(moves)
        forward, backward = np.empty_like(emit), np.ones_like(emit)
        forward[:, 0] = emit[:, 0] / emit[:, 0].sum(-1, keepdims=True)
        for t in range(1, _WINDOW):
            s = forward[:, t - 1] @ move * emit[:, t]
            forward[:, t] = s / s.sum(-1, keepdims=True)
        for t in range(_WINDOW - 2, -1, -1):
            s = (backward[:, t + 1] * emit[:, t + 1]) @ move.T
            backward[:, t] = s / s.sum(-1, keepdims=True)
        p = forward * backward
        p = p[..., 1] / p.sum(-1)
        error = np.where(real[use], y[use] - p, 0.0) * weight[:, None]
        flat = np.zeros(n)
        flat.reshape(-1, _WINDOW)[use] = error
        pair = forward[:, :-1, :, None] * move * (emit * backward)[:, 1:, None, :]
        pair /= pair.sum((-1, -2), keepdims=True)
        inner = real[use][:, 1:] * weight[:, None]
        seen = np.array([[(((y[use][:, :-1] == a) & (y[use][:, 1:] == b)) * inner).sum() for b in (0, 1)] for a in (0, 1)])
        grads = [np.bincount(column, weights=flat[row], minlength=len(kept)) - decay * total * 0.01 * w, error.sum(), seen - (pair * inner[..., None, None]).sum((0, 1)) - decay * total * moves]
        steps_now = []
        for k, g in enumerate(grads):
            squares[k] = squares[k] + g * g
            steps_now.append(rate * g / np.sqrt(squares[k]))
        w, bias, moves = w + steps_now[0], bias + steps_now[1], moves + steps_now[2]
    model = Field({f: float(x) for f, x in zip(kept, w)}, float(bias), moves)
    scorer = Scorer(model)
    x = np.array([[1.0, *scorer.summary(t)] for t in texts])
    beta = np.zeros(4)
    for _ in range(40):  # Newton's method, ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (toxic - p) - 0.05 * beta
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        beta = beta + np.linalg.solve(h, g)
    model.logistic = beta
    return model


class _Emissions(dict):
    def __init__(self, model: Field):
        super().__init__()
        self._model = model

    def __missing__(self, word: str) -> float:
        score = self[word] = self._model.emission(word)
        return score


class Scorer:
    """Scores texts with one field."""

    def __init__(self, model: Field):
        self.model, self._emissions = model, _Emissions(model)

    def evidence(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the words with evidence, their marginals, and how many words there are."""
        if len(self._emissions) > _CACHE:
            self._emissions.clear()
        words = text.split()
        e = np.fromiter(map(self._emissions.__getitem__, words), dtype=float, count=len(words))
        at = np.flatnonzero(e != self.model.bias)
        return at, marginals(self.model, at, e[at], len(words)) if len(at) else np.zeros(0), len(words)

    @staticmethod
    def aggregate(p: np.ndarray, n: int) -> tuple[float, float, float]:
        """What the score depends on: sum of the marginals, the largest, and the sum's share of the words."""
        return (math.log1p(p.sum()), float(p.max()), math.log1p(100 * p.sum() / n)) if len(p) else (0.0, 0.0, 0.0)

    def summary(self, text: str) -> tuple[float, float, float]:
        return self.aggregate(*self.evidence(text)[1:])

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a document and its toxic words: (start, end, marginal), code points, end exclusive."""
        at, p, n = self.evidence(text or "")
        x = np.array([1.0, *self.aggregate(p, n)])
        score = 1 / (1 + math.exp(-min(40.0, max(-40.0, float(x @ self.model.logistic)))))
        hits = dict(zip(at[p >= 0.5].tolist(), p[p >= 0.5].tolist()))
        return score, [(m.start(), m.end(), hits[k]) for k, m in enumerate(_NOT_BLANK.finditer(text)) if k in hits] if hits else []


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels to train on: of each class the `most` labelled documents with the smallest hash of doc_id; of several texts with one doc_id the first in order."""
    ranked = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").withColumn("draw", F.xxhash64("doc_id"))
    parts = [ranked.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(most) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]).select("doc_id", "toxic"))  # at most 2 * most rows
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [r.text or "" for r in rows], np.array([r.toxic for r in rows])


def _score(model: Field):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for frame in frames:
            got = [scorer.score(t) for t in frame.column(1).to_pylist()]
            spans = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in got], kind)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array([s for s, _ in got], pa.float64()), spans], ["doc_id", "score", "spans"])

    return run


def score(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score (0 to 1) and spans (start, end, p: the marginal) of toxic words, one row per row of docs.

    Whole texts are read, whatever their length. A null, empty or blank text has no spans and the score of a document
    without evidence; a null doc_id stays null; repeated rows get equal results; only doc_id and text are read.
    """
    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(_score(model), "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")

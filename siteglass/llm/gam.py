"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, on the bins of that feature; their sum is one lookup table per
feature. Pairs that explain most of what is left get two-dimensional tables, boosted the same way. A score is the sum of the
tables' entries at a text's bins. Learning reads a bounded sample; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import made, text_slices
from .labelled import QUALITY_FEATURES, labelled_sample, quality_features

BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAST = 32, 8, 6, 120, 0.1, 10.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def step(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value per bin of a tree of ``depth`` levels over the bins in order, from sums of gradients and Hessians."""
    value = np.full(len(grad), grad.sum() / (hess.sum() + 1.0))
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad), np.cumsum(hess)
        left_g, left_h, right_g, right_h = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(left_h < LEAST / 10) | (right_h < LEAST / 10)] = -1
        at = int(gain.argmax())
        if gain[at] > 1e-6:
            value[:at + 1], value[at + 1:] = step(grad[:at + 1], hess[:at + 1], depth - 1), step(grad[at + 1:], hess[at + 1:], depth - 1)
    return value


def corner(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree that cuts each of two features once, and what it gains."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    total_g, total_h = g[-1, -1], h[-1, -1]
    a_g, a_h = g[:-1, :-1], h[:-1, :-1]
    b_g, b_h = g[:-1, -1:] - a_g, h[:-1, -1:] - a_h
    c_g, c_h = g[-1:, :-1] - a_g, h[-1:, :-1] - a_h
    d_g, d_h = total_g - a_g - b_g - c_g, total_h - a_h - b_h - c_h
    gain = sum(x**2 / (y + 1) for x, y in ((a_g, a_h), (b_g, b_h), (c_g, c_h), (d_g, d_h))) - total_g**2 / (total_h + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(grad)
    for rows, columns, x, y in ((slice(0, i + 1), slice(0, j + 1), a_g, a_h), (slice(0, i + 1), slice(j + 1, None), b_g, b_h), (slice(i + 1, None), slice(0, j + 1), c_g, c_h), (slice(i + 1, None), slice(j + 1, None), d_g, d_h)):
        out[rows, columns] = x[i, j] / (y[i, j] + 1)
    return out, float(gain[i, j])


@dataclass
class Additive:
    """Tables of the model; ``bias`` alone where there was nothing to learn from."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        for i, table in enumerate(self.tables):
            out += table[b[:, i]]
        for i, j, table in self.pairs:
            out += table[coarse(b[:, i]), coarse(b[:, j])]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def coarse(b: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // BINS


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Additive:
    """Boost tables on rows ``x`` with labels ``y``; without rows of both labels the score is the share of ones (0.5 without rows)."""
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    share = min(max(share, 0.01), 0.99)
    model = Additive(float(np.log(share / (1 - share))), [], [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    for i in range(x.shape[1]):
        # A cut between two values that occur, so equal values stay in one bin.
        values = np.unique(np.quantile(x[:, i], quantiles, method="lower"))
        model.cuts.append(values[values > x[:, i].min()])
        model.tables.append(np.zeros(BINS))
    b = model.bins(x)
    margin = np.full(len(y), model.bias)

    def residuals(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(margin)
        return np.bincount(codes, weight * (y - p), size), np.bincount(codes, weight * p * (1 - p), size)

    for _ in range(rounds):
        for i in range(x.shape[1]):
            change = RATE * step(*residuals(b[:, i], BINS), depth=2)
            model.tables[i] += change
            margin += change[b[:, i]]
    c = coarse(b)
    codes = {(i, j): c[:, i] * PAIR_BINS + c[:, j] for i, j in combinations(range(x.shape[1]), 2)}
    square = lambda k: tuple(r.reshape(PAIR_BINS, PAIR_BINS) for r in residuals(codes[k], PAIR_BINS**2))
    best = sorted(codes, key=lambda k: -corner(*square(k))[1])[:PAIRS]
    tables = {k: np.zeros((PAIR_BINS, PAIR_BINS)) for k in best}
    for _ in range(rounds // 2):
        for k in best:
            change = RATE * corner(*square(k))[0]
            tables[k] += change
            margin += change.ravel()[codes[k]]
    model.pairs = [(i, j, tables[i, j]) for i, j in best]
    return model


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, label, weight, x): features of a sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield made(batch, label=batch.column("label"), weight=batch.column("weight"), x=pa.array([quality_features(t) for t in texts], pa.list_(pa.float64())))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, label int, weight double, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 10_000, target: str = "quality") -> Additive:
    sample, _ = labelled_sample(docs, labels, target, train, per_class, "gam")
    rows = feature_rows(sample).orderBy("doc_id", "x").collect()  # at most 2 * per_class rows
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(QUALITY_FEATURES))
    return fit(x, np.array([r.label for r in rows], dtype=float), np.array([r.weight for r in rows], dtype=float))


def score(docs: DataFrame, model: Additive, held_out: Column) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Null texts count as empty; other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            s = model.scores(np.array([quality_features(t) for t in texts]).reshape(len(texts), len(QUALITY_FEATURES)))
            yield made(batch, held_out=batch.column("held_out"), score=s, predicted=(s >= 0.5).astype(np.int32))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = 10_000) -> DataFrame:
    """Learn from labels outside ``held_out`` (a condition on doc_id), score every row of ``docs``.

    ``per_class`` bounds the labelled rows learned from. Empty labels, or labels of one class, give one score for all. Repeated rows
    are scored each; a null id is scored and teaches nothing.
    """
    return score(docs, learn(docs, labels, ~held_out, per_class), held_out)

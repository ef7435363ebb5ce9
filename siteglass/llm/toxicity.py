"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a fixed and of a learned lexicon, second-person words near lexicon words, capitals, punctuation
and obfuscated spellings. The lexicon is learned on one half of a bounded labelled sample and the trees on the other,
so the trees see its densities as they are on new texts; a third of the second half is kept for calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import made, text_slices
from .gam import sigmoid
from .labelled import BANG, LOWER, PUNCTUATION, SYMBOL, UPPER, character_counts, labelled_sample, sketch

#: Common insults, and second-person words of the corpus languages.
INSULTS = frozenset("idiot moron stupid dumb trash garbage pathetic worthless disgusting clown scum loser fool imbecile vermin filth freak pig liar coward hate kill ugly".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes ti tus vos".split())
#: Characters that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W_]+")
OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$!*._-]+[^\W\d_]+[0-9@$!*\w]*")
PREFIXES = range(3, 8)
NEAR = 5
FEATURES = (
    "insults", "learned", "hits", "distinct_hits", "second_person", "second_person_near", "upper", "upper_words", "bangs", "punctuation", "symbols", "obfuscated", "obfuscated_hits", "log_words",
)


def terms_of(word: str) -> set[str]:
    """A word as a lexicon knows it: itself (``=word``) and its beginnings (``beginning``)."""
    return {f"={word}", *(word[:n] for n in PREFIXES if n <= len(word))}


@dataclass
class Features:
    """Dense features of texts; remembers which words it has met."""

    lexicon: frozenset[str]
    known: dict[str, int] = field(default_factory=dict)

    def kind(self, word: str) -> int:
        """1: insult, 2: learned term, 3: both."""
        if (k := self.known.get(word)) is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            k = self.known[word] = (word in INSULTS) + 2 * (not self.lexicon.isdisjoint(terms_of(word)))
        return k

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        n = max(1, len(words))
        counts = character_counts(text)
        kinds = list(map(self.kind, words))
        hits = [i for i, k in enumerate(kinds) if k]
        address = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if hits and address:
            at = np.searchsorted(address, hits)
            padded = np.array([-10**9, *address, 10**9])
            near = int((np.minimum(np.array(hits) - padded[at], padded[at + 1] - np.array(hits)) <= NEAR).sum())
        odd = OBFUSCATED.findall(low)
        plain = [re.sub(r"[*._-]", "", w.translate(LOOKALIKES)) for w in odd]
        letters = max(1, counts[UPPER] + counts[LOWER])
        return [
            100 * sum(k & 1 for k in kinds) / n, 100 * sum(k >> 1 for k in kinds) / n, math.log1p(len(hits)), math.log1p(len({words[i] for i in hits})), 100 * len(address) / n, near / max(1, len(hits)),
            counts[UPPER] / letters, sum(w.isupper() for w in text.split()) / n, counts[BANG] / n, counts[PUNCTUATION] / n, counts[SYMBOL] / n, 100 * len(odd) / n, 100 * sum(w in INSULTS for w in plain) / n, math.log1p(len(words)),
        ]


def lexicon_of(sample: DataFrame, size: int = 2000, least: int = 8, share: float = 0.8) -> frozenset[str]:
    """Terms that mark label 1: in at least ``least`` texts of it, and at least ``share`` of their texts by weight of the classes.

    ``sample``: (doc_id, text, label). Texts with the same sketch (copies, most near copies) count once per label. Counts are
    summed per slice of texts before the shuffle; the ``size`` best terms come back.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, limit=1 << 20):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(texts, batch.column("label").to_pylist()):
                found: set[str] = set()
                for word in set(WORD.findall(text.lower())):
                    if len(word) > 2:
                        found |= terms_of(word)
                seen[label].update(found)
            for label, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "label", "n"])

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return frozenset()
    ones, zeros = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0))
    terms = sample.select("text", "label").mapInArrow(run, "term string, label int, n bigint").groupBy("term").agg(ones.alias("p"), zeros.alias("q"))
    odds = F.col("p") / (F.col("p") + F.col("q") * F.lit(sizes[1] / sizes[0]))
    best = terms.where((F.col("p") >= least) & (odds >= share)).orderBy(F.desc(F.col("p") * (odds - 0.5)), "term").limit(size)
    return frozenset(r.term for r in best.collect())


@dataclass
class Trees:
    """Boosted trees over binned features: per tree the feature and cut of each inner node by level, and leaf values."""

    bias: float
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if not self.trees or not len(x):
            return out
        b, rows = self.bins(x), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.interp(m, *self.knots) if self.knots else sigmoid(m)


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48) -> Trees:
    """Boost trees of ``depth`` levels by second-order gains; without rows of both labels the score is the share of ones (0.5 without rows)."""
    share = min(max(float((y * weight).sum() / weight.sum()) if len(y) else 0.5, 0.01), 0.99)
    model = Trees(math.log(share / (1 - share)), [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    for i in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        # Densities are zero in most texts: cuts among the others, too.
        rest = x[x[:, i] > x[:, i].min(), i]
        more = np.quantile(rest, np.linspace(0, 1, 9)[:-1], method="lower") if len(rest) else []
        values = np.unique([*values, *more])
        model.cuts.append(values[values > x[:, i].min()])
    b, size = model.bins(x), bins + 16
    margin = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = sigmoid(margin)
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, size)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for i in range(x.shape[1]):
                code = (node - first) * size + b[:, i]
                gs, hs = (np.bincount(code, v, count * size).reshape(count, size).cumsum(1) for v in (g, h))
                tg, th = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (tg - gs) ** 2 / (th - hs + 1) - tg**2 / (th + 1)
                gain[(hs < 1) | (th - hs < 1)] = -1
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better], feature[first:first + count][better], cut[first:first + count][better] = top[better], i, at[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        code = node - (2**depth - 1)
        leaf = rate * np.bincount(code, g, 2**depth) / (np.bincount(code, h, 2**depth) + 1)
        model.trees.append((feature, cut, leaf))
        margin += leaf[code]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Knots of the nondecreasing fit of labels to margins (pool adjacent violators), joined by straight lines."""
    if len(y) == 0 or y.min() == y.max():
        return None
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, of weights, first and last margin
    for m, label, w in zip(margin[order], y[order], weight[order]):
        blocks.append([label * w, w, m, m])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, v, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + v, blocks[-1][2], last]
    at, value = [], []
    for s, v, first, last in blocks:
        at += [first, last]
        value += [s / v] * 2
    return np.array(at), np.array(value)


@dataclass
class Toxicity:
    lexicon: frozenset[str]
    trees: Trees


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 8000, target: str = "toxic") -> Toxicity:
    """Lexicon, trees and calibration from at most ``per_class`` labelled texts of each class for which ``train`` holds."""
    sample, _ = labelled_sample(docs, labels, target, train, per_class, "toxicity")

    def sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield made(batch, sketch=pa.array([sketch(t) for t in texts], pa.int64()), label=batch.column("label"), text=pa.array(texts, pa.string()))

    kind = sample.schema["doc_id"].dataType.simpleString()
    half = F.xxhash64("doc_id", F.lit("half")) % 2 == 0
    words = sample.where(half).mapInArrow(sketches, f"doc_id {kind}, sketch bigint, label int, text string")
    lexicon = lexicon_of(words.groupBy("sketch", "label").agg(F.min_by("text", "doc_id").alias("text")))
    rows = dense(sample.where(~half), lexicon, ("label", "weight"), "label int, weight double").orderBy("doc_id", "x").collect()  # at most 2 * per_class rows
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    y, weight = (np.array([r[c] for r in rows], dtype=float) for c in ("label", "weight"))
    last = np.arange(len(rows)) % 3 == 2
    trees = fit_trees(x[~last], y[~last], weight[~last])
    trees.knots = isotonic(trees.margin(x[last]), y[last], weight[last]) if trees.trees else None
    return Toxicity(lexicon, trees)


def dense(docs: DataFrame, lexicon: frozenset[str], carried: tuple[str, ...], kinds: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch, texts in text_slices(batches):
            yield made(batch, **{c: batch.column(c) for c in carried}, x=pa.array([features(t) for t in texts], pa.list_(pa.float64())))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *carried).mapInArrow(run, f"doc_id {kind}, {kinds}, x array<double>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = 8000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, learned from labels outside ``held_out`` (a condition on doc_id).

    Null texts count as empty. Empty labels, or labels of one class, give one score for all. Repeated rows are scored each; a
    null id is scored and teaches nothing. Other columns are ignored.
    """
    model = learn(docs, labels, ~held_out, per_class)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon)
        for batch, texts in text_slices(batches):
            s = model.trees.scores(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
            yield made(batch, held_out=batch.column("held_out"), score=s, predicted=(s >= 0.5).astype(np.int32))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

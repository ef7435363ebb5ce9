"""Bounded labelled samples, and dense whole-text features for the classifiers."""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import below, kept

UPPER, LOWER, DIGIT, SPACE, PUNCTUATION, SYMBOL, BANG, PIPE, OTHER = range(9)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, per_class: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Texts to learn from: (doc_id, text, label, weight), at most ``per_class`` rows of each class, and the classes' sizes.

    ``train`` is a condition on doc_id: only labels for which it holds are read. Of each class the ids with the lowest hash
    are taken, so the sample does not depend on partitioning. Rows with a null id or label are ignored; several
    labels of an id are averaged. Rows of equal id and text are one row, whose ``weight`` counts each of them; of an id with many texts
    those with the lowest hash are taken, and stand for the rest. ``weight`` restores the classes' shares.
    """
    marks = labels.where("doc_id is not null").where(F.col(target).isNotNull()).where(train).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("label"))
    marks = kept(marks, f"{name}-labels")
    sizes = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label, size in sorted(sizes.items()):
        part = lowest(marks.where(F.col("label") == label), F.xxhash64("doc_id"), ["doc_id"], per_class, size)
        part = part.withColumn("weight", F.lit(size / min(size, per_class)))
        picked = part if picked is None else picked.union(part)
    if picked is None:
        picked = marks.withColumn("weight", F.lit(1.0))
    # At most 2 * per_class rows of three numbers: a bounded broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "text", "label", "weight").agg(F.count("*").alias("n"))
    rows = kept(found.select("doc_id", "text", "label", (F.col("weight") * F.col("n")).alias("weight")), f"{name}-sample")
    held = {r.label: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    if all(r.n <= per_class for r in held.values()):
        return rows, sizes
    mark, few = F.xxhash64("doc_id", "text"), None
    for label, r in sorted(held.items()):
        part = rows.where(F.col("label") == label)
        if r.n > per_class:
            part = kept(lowest(part, mark, ["doc_id", "text"], per_class, r.n), f"{name}-part")
            part = part.withColumn("weight", F.col("weight") * F.lit(r.weight / part.agg(F.sum("weight")).first()[0]))
        few = part if few is None else few.unionByName(part)
    return kept(few, f"{name}-bounded"), sizes


def lowest(frame: DataFrame, mark: Column, ties: list[str], rows: int, size: int) -> DataFrame:
    """The ``rows`` of ``size`` rows with the lowest hash. A threshold of twice as many is applied first, so that partitions
    don't each send ``rows`` of theirs."""
    return frame.where(mark <= below(2 * rows + 100, size)).orderBy(mark, *ties).limit(rows)


@functools.cache
def classes_of_characters() -> np.ndarray:
    """Class of every character of the basic plane; the last entry stands for all others."""
    out = np.full(65537, OTHER, dtype=np.uint8)
    for i in range(65536):
        kind = unicodedata.category(chr(i))
        if kind in ("Lu", "Lt"):
            out[i] = UPPER
        elif kind[0] == "L" or kind[0] == "M":
            out[i] = LOWER
        elif kind[0] == "N":
            out[i] = DIGIT
        elif kind[0] == "Z" or chr(i).isspace():
            out[i] = SPACE
        elif kind[0] == "P":
            out[i] = PUNCTUATION
        elif kind[0] == "S":
            out[i] = SYMBOL
    for c in "#*$%&<>@~^\\":
        out[ord(c)] = SYMBOL
    out[ord("!")], out[ord("|")] = BANG, PIPE
    return out


def character_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(classes_of_characters()[np.minimum(codes, 65536)], minlength=9)


QUALITY_FEATURES = (
    "log_words", "mean_length", "upper", "digits", "symbols", "bangs", "pipes", "punctuation", "distinct", "same_as_last", "repeated_windows", "repeated_lines",
    "words_per_line", "short_words", "top_word", "other_characters",
)


def quality_features(text: str) -> list[float]:
    """Whole-text statistics, in the order of QUALITY_FEATURES; an empty text gives zeros."""
    counts = character_counts(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(QUALITY_FEATURES)
    letters = max(1, counts[UPPER] + counts[LOWER])
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    windows = n - 2
    return [
        np.log1p(n), sum(map(len, words)) / n, counts[UPPER] / letters, counts[DIGIT] / n, counts[SYMBOL] / n, counts[BANG] / n, counts[PIPE] / n, counts[PUNCTUATION] / n,
        len(seen) / n, sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(zip(words, words[1:], words[2:]))) / windows if windows > 0 else 0.0,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(f for w, f in seen.items() if len(w) < 4) / n, max(seen.values()) / n, counts[OTHER] / n,
    ]


def sketch(text: str) -> int:
    """Least hash of the 3-word windows: copies and most near copies agree, other texts differ."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 7) >> 1
    return min(map(xxhash.xxh64_intdigest, map(b" ".join, zip(words, words[1:], words[2:])))) >> 1

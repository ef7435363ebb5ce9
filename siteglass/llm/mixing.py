"""Mixing to target weights with soft domain membership.

A naive Bayes classifier over byte pairs, learned from a labelled table, gives each document posteriors over the domains. A projected
gradient method then fits a rate of at least zero per document, such that the expected tokens of each domain meet its share of
the total. A gradient is one number per domain, so an iteration is one aggregation of the documents' posteriors and nothing
but k totals and a k x k matrix reaches the driver; every step projects the rates, which are folds of the steps over the posteriors.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import SPACES, kept, made, text_slices

CODES = 1 << 16
#: No limit: the fit ends at the tolerance or at the optimum.
ITERATIONS, TOLERANCE, LEAST_DAMPING = None, 1e-4, 1e-9

# Lower case for A-Z; other bytes stay as they are.
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def byte_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte pairs of the texts, each text between blanks, and where each text's codes begin."""
    data = [b" " + t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    low = LOWER[np.frombuffer(b"".join(data), dtype=np.uint8)]
    codes = low[:-1] * 256 + low[1:]
    starts = np.cumsum([0, *map(len, data)])[:-1]
    return codes, starts


def learn_domains(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domain names, log priors and log likelihoods (domains by byte pairs) from rows (text, domain); all rows teach.

    Rows without a domain are ignored, null texts count as empty. Counts are summed per slice of texts, then by shuffle; at most one
    number per domain and byte pair comes back. No rows give no domains.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            domains = np.array(batch.column("domain").to_pylist(), dtype=object)
            for d in set(domains.tolist()):
                codes, _ = byte_pairs([t for t, x in zip(texts, domains) if x == d])
                counts = np.bincount(codes, minlength=CODES)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([d] * (len(at) + 1), pa.string()), pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[counts[at], (domains == d).sum()].astype(np.int64))], names=["domain", "code", "n"])

    rows = labelled.where("domain is not null").select("text", F.col("domain").cast("string").alias("domain")).mapInArrow(run, "domain string, code int, n bigint").groupBy("domain", "code").agg(F.sum("n").alias("n")).collect()
    names = sorted({r.domain for r in rows})
    prior, counts = np.zeros(len(names)), np.full((len(names), CODES), smoothing)
    for r in rows:
        if r.code < 0:
            prior[names.index(r.domain)] = r.n
        else:
            counts[names.index(r.domain), r.code] += r.n
    with np.errstate(divide="ignore"):
        return names, np.log(prior / max(1, prior.sum())), np.log(counts / counts.sum(1, keepdims=True))


def posteriors(docs: DataFrame, prior: np.ndarray, likelihood: np.ndarray, names: list[str]) -> DataFrame:
    """The named columns of ``docs`` and ``p``, the domain posteriors of the whole text.

    Byte pairs of a text are far from independent, so their evidence counts by the square root of their number: long texts stay
    soft where they are mixed. An empty text has the prior.
    """
    table = np.ascontiguousarray(likelihood.astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, limit=4 << 20):
            codes, starts = byte_pairs(texts)
            pairs = np.diff(np.r_[starts, len(codes) + 1]) - 1
            sums = np.stack([np.add.reduceat(row[codes], starts, dtype=np.float64) for row in table], axis=1)
            score = prior + sums / np.sqrt(np.maximum(pairs, 1))[:, None]
            score[[not t for t in texts]] = prior
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(list(p), pa.list_(pa.float64()))], names=[*names, "p"])

    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("p", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


def rate(steps: list[tuple[list[float], list[float]]], posterior: Column) -> Column:
    """A document's rate after the steps (slope, move): from 1, a step against the gradient, never below zero.

    A rate at zero whose gradient would lower it further rests; the others move by their posteriors times ``move``.
    """
    if not steps:
        return F.lit(1.0)
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    taken = F.array(*[F.struct(numbers(slope).alias("slope"), numbers(move).alias("move")) for slope, move in steps])
    return F.aggregate(taken, F.lit(1.0), lambda r, t: F.when((r <= 0) & (dot(posterior, t["slope"]) > 0), 0.0).otherwise(F.greatest(F.lit(0.0), r - dot(posterior, t["move"]))))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def fit_rates(rows: DataFrame, targets: list[float], iterations: int | None = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[list[tuple[list[float], list[float]]], list[float]]:
    """Projected gradient steps on the rates of rows (n tokens, p posteriors), and the shares reached.

    Minimises half the squared distance between expected domain totals and ``targets`` (shares of all tokens) over rates of at least
    zero, in the metric of the documents' tokens. There the gradient of a rate is p . slope with slope = shares - targets, so a step is one vector per
    domain: rates become max(0, rate - p . move), and a row's rate is the fold of all steps over its posteriors. The move is the slope scaled by the damped inverse
    Gram matrix of the rows with a rate above zero, so that rare domains move as fast as hot ones. Rates at zero that the gradient holds there rest, so the
    scaling can't push them off. A step is taken if it lowers the objective by a part of what the gradient promises over the way gone; else
    the damping grows, towards a short plain gradient step, which always does. The fit ends when the targets are met, or at the
    optimum, where a plain projected step no longer moves the rates. None for ``iterations`` (aggregations after the first) sets no limit.
    """
    k, target = len(targets), np.array(targets, dtype=float)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def totals(taken: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """At the rates of all steps: shares and Gram matrix of the rows above zero; before the last step, how far a plain step along ``slope`` moves the rates."""
        rated = rows.select("n", "p", rate(taken, F.col("p")).alias("r"), rate(taken[:-1], F.col("p")).alias("before"))
        at, live = (lambda i: F.get("p", F.lit(i))), F.when(F.col("r") > 0, F.col("n")).otherwise(0.0)
        moved = F.col("before") - F.greatest(F.lit(0.0), F.col("before") - dot(F.col("p"), F.array(*[F.lit(float(x)) for x in slope])))
        got = rated.agg(F.sum("n"), F.sum(F.col("n") * moved * moved), *[F.sum(F.col("n") * F.col("r") * at(i)) for i in range(k)], *[F.sum(live * at(i) * at(j)) for i, j in pairs]).first()
        if not got[0]:
            return np.zeros(k), np.zeros((k, k)), -1.0
        values, gram = np.array(got[1:], dtype=float) / got[0], np.zeros((k, k))
        for (i, j), x in zip(pairs, values[1 + k:]):
            gram[i, j] = gram[j, i] = x
        return values[1:1 + k], gram, float(np.sqrt(values[0]))

    shares, gram, moved = totals([], np.zeros(k))
    if moved < 0:
        return [], [0.0] * k
    steps, damping, used, steepest = [], LEAST_DAMPING, 0, float(np.trace(gram))
    while np.abs(shares - target).max() > tolerance and (iterations is None or used < iterations):
        slope, used = shares - target, used + 1
        step = (slope.tolist(), np.linalg.solve(gram + damping * np.eye(k), slope).tolist())
        near, near_gram, moved = totals([*steps, step], slope)
        if moved <= tolerance / 10:
            break
        gain = (slope @ slope - (near - target) @ (near - target)) / 2
        if gain > 0 and gain >= 1e-4 * (slope @ (shares - near)):
            steps.append(step)
            shares, gram, damping = near, near_gram, max(damping / 10, LEAST_DAMPING)
        elif damping > 1e3 * steepest:  # a step so short that doubles tell no difference
            break
        else:
            damping = max(damping * 10, 1e-6)
    return steps, [float(x) for x in shares]


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, columns: list[str] | None = None, iterations: int | None = ITERATIONS) -> DataFrame:
    """``docs``, its given ``columns`` (None: all), with n_words, p_<domain> for each domain, rate and copies.

    ``labelled`` (text, domain) teaches the domains. ``targets``: weight per domain, scaled to sum 1, missing ones are 0; None gives
    equal weights. ``rate`` is the expected number of copies of the document in the mixture, ``copies`` its whole-number draw: the rate rounded
    up or down by a hash of id and text. Words (white-space separated) are the tokens that totals count. Null and
    empty texts have 0 words, the prior as posteriors, and a rate like any other; repeated rows and null ids are rated each. No labelled
    rows: no p_ columns, rate 1. Columns of ``docs`` with one of the new names are replaced. Domains that no document has can't reach a target; the rest is then fitted as closely as squares allow.
    The metadata of a p_ column has the domain's target and the share reached; a target that is missed gives a warning.
    """
    names, prior, likelihood = learn_domains(labelled)
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("double")
    new = {"n_words", "rate", "copies", *(f"p_{n}" for n in names)}
    shown = [F.col(f"`{c}`") for c in (docs.columns if columns is None else columns) if c not in new]
    if not names:
        return docs.select(*shown, words.cast("long").alias("n_words"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    weights = [1.0 if targets is None else max(0.0, targets.get(n, 0.0)) for n in names]
    scale = sum(weights) or 1.0
    drawn = (F.xxhash64("doc_id", "text", F.lit("draw")) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000
    carried = docs.select("text", F.struct(*shown).alias("row"), words.alias("n"), drawn.alias("draw"))
    rows = kept(posteriors(carried, prior, likelihood, ["row", "n", "draw"]), "posteriors")
    targets = [w / scale for w in weights]
    steps, shares = fit_rates(rows.select("n", "p"), targets, iterations)
    if max(abs(a - b) for a, b in zip(shares, targets)) > TOLERANCE:
        warnings.warn(f"target shares not met: {dict(zip(names, targets))}, reached: {dict(zip(names, shares))}", stacklevel=2)
    return rows.select(
        "row.*", F.col("n").cast("long").alias("n_words"), *[F.get("p", F.lit(i)).alias(f"p_{n}", metadata={"target": targets[i], "reached": shares[i]}) for i, n in enumerate(names)],
        rate(steps, F.col("p")).alias("rate"), F.floor(rate(steps, F.col("p")) + F.col("draw")).alias("copies"),
    )

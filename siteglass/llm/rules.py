"""Learned decision lists: threshold conjunctions grown and pruned by sequential covering.

Statistics of the texts are column expressions. Rules are learned from labelled statistics by grouped counts: growing a term
reads one histogram per feature, pruning reads one row of sums. The list is emitted as one ordered conditional expression.
No Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, fold, kept, whole

SYMBOLS = "#*$%&|<>"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Cut points offered to the rules: shares and rates, and mean word length.
SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
FEATURES = {
    "symbols": SHARES, "bangs": SHARES, "upper": SHARES, "digits": SHARES, "dup_lines": SHARES, "repeats": SHARES, "distinct": SHARES,
    "mean_chars": (1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 15, 20),
}


@dataclass(frozen=True)
class Term:
    feature: str
    low: bool  # below the threshold, else at or above it
    threshold: float

    def over(self, value: Column) -> Column:
        return value < self.threshold if self.low else value >= self.threshold


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which all terms hold."""

    terms: tuple[Term, ...]
    precision: float

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'<' if t.low else '>='} {t.threshold:g}" for t in self.terms)


def removed(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(windows: Column) -> Column:
    """Words covered by the 3-word windows (given by hash) that occur twice or more."""

    def covered(ordered: Column) -> Column:
        again = F.filter(ordered, lambda e, i: (e["h"] == F.get(ordered, i - 1)["h"]) | F.coalesce(e["h"] == F.get(ordered, i + 1)["h"], F.lit(False)))
        places = F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
        return F.size(F.array_distinct(places))

    def slow(all_windows: Column) -> Column:
        return bound(F.array_sort(F.transform(all_windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(slow(windows))


def with_stats(docs: DataFrame, carried: Column) -> DataFrame:
    """(row, stats): a struct of carried columns of ``docs`` and one of whole-text statistics; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    cut = docs.select(
        carried.alias("row"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS)).alias("_words"), lines.alias("_lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("_chars"), removed(text, SYMBOLS).cast("long").alias("_symbols"),
        removed(text, "!").alias("_bangs"), removed(text, "0123456789").alias("_digits"), F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("_upper"),
    )
    hashed = cut.select(
        "row", "_chars", "_symbols", "_bangs", "_digits", "_upper", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.size("_lines").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"),
    )
    windows = F.when(
        F.size("_hashes") > 3,  # a single window can't occur twice
        F.transform(F.sequence(F.lit(0), F.size("_hashes") - 3), lambda i: F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = hashed.select(
        "row", "_chars", "_symbols", "_bangs", "_digits", "_upper", "_n_lines", "_dup", F.size("_hashes").cast("long").alias("_n"),
        F.size(F.array_distinct("_hashes")).alias("_distinct"), windows.alias("_windows"),
    )
    repeats = counted.select(*[c for c in counted.columns if c != "_windows"], repeated_words(F.col("_windows")).cast("long").alias("_repeats"))
    per_word = lambda c: F.col(c) / F.greatest("_n", F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest("_chars", F.lit(1))
    return repeats.select(
        "row",
        F.struct(
            F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"),
            F.col("_repeats").alias("n_repeat_words"), ((F.col("_n") < 50) | (100 * F.col("_repeats") > 50 * F.col("_n"))).alias("base_failed"),
            per_word("_symbols").alias("symbols"), per_word("_bangs").alias("bangs"), per_char("_upper").alias("upper"), per_char("_digits").alias("digits"),
            (F.col("_dup") / F.greatest("_n_lines", F.lit(1))).alias("dup_lines"), per_word("_repeats").alias("repeats"), per_word("_distinct").alias("distinct"),
            per_word("_chars").alias("mean_chars"),
        ).alias("stats"),
    )


def learn(stats: DataFrame, labels: DataFrame, max_rules: int = 12, max_terms: int = 3, min_precision: float = 0.8, min_count: int = 5) -> list[Rule]:
    """Decision list for rejecting texts, learned from all labelled rows of ``stats`` (doc_id, stats).

    ``labels`` (doc_id, quality): rows with a null id or label are ignored, several labels of an id are averaged. Two thirds of
    the ids grow rules, the others prune them: a rule keeps the first terms that do best on the pruning rows, and the list ends
    where a rule falls under ``min_precision`` there or covers under ``min_count`` rows. Texts that fail the base conditions are
    left out, as no rule is asked about them. No labels of both kinds: an empty list.
    """
    names = list(FEATURES)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    bins = F.array(*[sum((F.col(f"stats.{f}") >= t).cast("int") for t in FEATURES[f]) for f in names])
    table = kept(
        stats.join(marks, "doc_id").where("not stats.base_failed").select(bins.alias("bins"), "bad", (fold("doc_id", 3) == 2).alias("prune"))
        .groupBy("bins", "bad", "prune").agg(F.count("*").alias("n")),
        "rule-patterns",
    )

    def in_bins(term: Term) -> Column:
        value, cut = F.get("bins", F.lit(names.index(term.feature))), FEATURES[term.feature].index(term.threshold) + 1
        return value < cut if term.low else value >= cut

    def all_of(terms) -> Column:
        out = F.lit(True)
        for t in terms:
            out = out & in_bins(t)
        return out

    number = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    rules: list[Rule] = []
    left = table
    while len(rules) < max_rules:
        terms: list[Term] = []
        best_share = None
        while len(terms) < max_terms:
            open_rows = left.where(~F.col("prune") & all_of(terms)).select(F.posexplode("bins").alias("f", "b"), "bad", "n")
            seen: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in range(len(names))}
            for row in open_rows.groupBy("f", "b").agg(number(F.col("bad")).alias("p"), number(~F.col("bad")).alias("q")).collect():
                seen[row.f][row.b] = (row.p, row.q)
            p0, q0 = (sum(x[k] for x in seen[0].values()) for k in (0, 1))
            if p0 < min_count or q0 == 0:
                break
            before, found = math.log2(p0 / (p0 + q0)), None
            for i, f in enumerate(names):
                p = q = 0
                for b, cut in enumerate(FEATURES[f]):
                    dp, dq = seen[i].get(b, (0, 0))
                    p, q = p + dp, q + dq
                    for low, (x, y) in ((True, (p, q)), (False, (p0 - p, q0 - q))):
                        if x >= min_count and (gain := x * (math.log2(x / (x + y)) - before)) > (found[0] if found else 1e-9):
                            found = (gain, Term(f, low, cut))
            if not found:
                break
            terms.append(found[1])
        if not terms:
            break
        sums = [number(all_of(terms[:k]) & (F.col("prune") == prune) & (F.col("bad") == bad)) for k in range(1, len(terms) + 1) for prune in (True, False) for bad in (True, False)]
        got = left.agg(*[s.alias(str(i)) for i, s in enumerate(sums)]).first()
        options = []
        for k in range(len(terms)):
            p, q, grow_p, grow_q = got[4 * k:4 * k + 4]
            # The Laplace estimate keeps a rule that the pruning rows hardly reach from counting as sure.
            options.append(((p + 1) / (p + q + 2) if p + q else grow_p / max(1, grow_p + grow_q) - 0.1, min(p + grow_p, 10 * min_count), -k))
        best_share, covered, k = max(options)
        if best_share < min_precision or covered < min_count:
            break
        rules.append(Rule(tuple(terms[:1 - k]), round(best_share, 4)))
        left = left.where(~all_of(rules[-1].terms))
    return rules


def verdict(rules: list[Rule], stats: str = "stats") -> tuple[Column, Column]:
    """(kept, rule): the list as one ordered condition; ``rule`` is the number of the rule that rejected, from 1."""
    fired, number = F.when(F.col(f"{stats}.base_failed"), False), F.when(F.col(f"{stats}.base_failed"), F.lit(None).cast("int"))
    for i, rule in enumerate(rules):
        holds = F.lit(True)
        for t in rule.terms:
            holds = holds & t.over(F.col(f"{stats}.{t.feature}"))
        fired, number = fired.when(holds, False), number.when(holds, i + 1)
    return fired.otherwise(True), number


def judge(docs: DataFrame, labels: DataFrame, carry: bool = False) -> tuple[DataFrame, list[Rule]]:
    """Verdicts of all ``docs`` by a list learned from ``labels``, and the list.

    Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule. With ``carry`` the rows
    are (row, kept) instead, where row is a struct of all columns of ``docs``. Whole texts are read once, for learning and judging. A null text
    counts as empty and fails the base conditions; repeated rows are judged each; null ids are judged and teach nothing.
    """
    stats = kept(with_stats(docs, whole(docs) if carry else F.struct("doc_id")), "rule-stats")
    rules = learn(stats.select("row.doc_id", "stats"), labels)
    keep, number = verdict(rules)
    if carry:
        return stats.select("row", keep.alias("kept")), rules
    base = [F.col(f"stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return stats.select("row.doc_id", *base, keep.alias("kept"), number.alias("rule")), rules

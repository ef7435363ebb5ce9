"""Snapshots and scores over time: latest, change detection, run comparison, score cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import latest, with_previous
from .tables import CRITERIA


def latest_snapshot(snapshots: DataFrame, columns: Sequence[str]) -> DataFrame:
    return latest(snapshots, ["page_id"], ["snapshot_at", "snapshot_id"], columns)


def latest_score(scores: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("page_id",)) -> DataFrame:
    return latest(scores, list(keys), ["scored_at", "score_id"], columns)


def with_change(snapshots: DataFrame, value: str = "content_hash", bucket: str = "day") -> DataFrame:
    """Add ``changed``: the content differs from the page's previous snapshot (none counts as changed).

    ``bucket`` is the time slice one task sorts at a time for a page; a busier source wants a finer one.
    """
    prior = with_previous(
        snapshots, ["page_id"], F.date_trunc(bucket, "snapshot_at"), ["snapshot_at", "snapshot_id"], value, "_prev"
    )
    same = F.col("_prev").isNotNull() & F.col("_prev.value").eqNullSafe(F.col(value))
    return prior.withColumn("changed", ~same).drop("_prev")


def snapshot_gate(snapshots: DataFrame, run_type: Column) -> DataFrame:
    """Snapshots worth storing: changed content, or any page of a full run."""
    return with_change(snapshots).filter(F.col("changed") | (run_type == "full"))


def score_history(scores: DataFrame, bucket: str = "day") -> DataFrame:
    """Scores with the difference to the page's previous score (null for the first)."""
    prior = with_previous(
        scores, ["page_id"], F.date_trunc(bucket, "scored_at"), ["scored_at", "score_id"], "overall_score", "_prev"
    )
    return prior.withColumn("delta", F.col("overall_score") - F.col("_prev.value")).drop("_prev")


def compare_runs(scores: DataFrame, old: Column, new: Column) -> DataFrame:
    """page_id, old_score, new_score, change: latest score of each side, in one aggregation."""
    order = F.struct("scored_at", "score_id")
    sides = scores.filter(old | new).groupBy("page_id").agg(
        F.max_by(F.when(old, F.col("overall_score")), F.when(old, order)).alias("old_score"),
        F.max_by(F.when(new, F.col("overall_score")), F.when(new, order)).alias("new_score"),
    )
    return sides.withColumn("change", F.col("new_score") - F.col("old_score"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count_if(F.col("change") > 0).alias("improved"),
        F.count_if(F.col("change") < 0).alias("declined"),
        F.count_if(F.col("change") == 0).alias("stable"),
        F.coalesce(F.sum("change"), F.lit(0)).alias("total_change"),
    )


def unchanged_between(snapshots: DataFrame, old: Column, new: Column) -> DataFrame:
    """(page, hash) pairs seen in both runs, with how often; counting, so repeated snapshots never multiply."""
    return (
        snapshots.filter(old | new)
        .groupBy("page_id", "content_hash")
        .agg(F.count_if(old).alias("in_old"), F.count_if(new).alias("in_new"))
        .filter("in_old > 0 and in_new > 0")
    )


def removed_pages(snapshots: DataFrame, old: Column, new: Column) -> DataFrame:
    """Pages of the old run that the new run no longer has."""
    return (
        snapshots.groupBy("page_id").agg(F.count_if(old).alias("_old"), F.count_if(new).alias("_new"))
        .filter("_old > 0 and _new = 0").select("page_id")
    )


def duplicate_content(snapshots: DataFrame, key: str = "content_hash") -> DataFrame:
    """Hashes that occur more than once."""
    return snapshots.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def cache_key(content_hash: Column, version: Column | str) -> Column:
    return F.concat(content_hash, F.lit("_"), F.lit(version) if isinstance(version, str) else version)


def with_cache(items: DataFrame, cache: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left-join items to the latest cached score of their ``cache_key``: ``hit`` and the reused columns.

    Tokens of a hit are 0. The cache is reduced to one row per key before the join.
    """
    best = latest(cache, ["cache_key"], ["scored_at", "score_id"], columns).withColumn("_hit", F.lit(True))
    joined = items.join(best, "cache_key", "left")
    return joined.withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def criteria_deltas(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Per-criterion change of two criteria maps (a missing criterion is 0), plus both movers' lists.

    ``improved`` and ``declined`` hold struct<size, criterion, delta>, largest move first, then by name.
    """
    deltas = F.map_zip_with(
        before, after, lambda k, a, b: (F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0))).cast("int")
    )
    known = F.map_filter(deltas, lambda k, v: k.isin(*CRITERIA))

    def movers(sign: int) -> Column:
        moved = F.map_entries(F.map_filter("deltas", lambda k, v: v * sign > 0))
        sized = F.transform(moved, lambda e: F.struct((-F.abs(e["value"])).alias("size"), e["key"].alias("criterion"), e["value"].alias("delta")))
        return F.array_sort(sized)

    return pairs.withColumn("deltas", known).withColumns({"improved": movers(1), "declined": movers(-1)})


def rescore_batch(pages: DataFrame) -> DataFrame:
    """Pages to score again: those with a current snapshot, and the run to book them on.

    The run is the one of the first such page (by page_id).
    """
    chosen = pages.filter("current_snapshot_id is not null")
    run = chosen.agg(F.min_by("last_crawl_run_id", "page_id").alias("booked_run_id")).withColumn("_k", F.lit(1))
    # One row, joined on a constant key.
    return chosen.select("page_id", "current_snapshot_id", F.lit(1).alias("_k")).join(F.broadcast(run), "_k").drop("_k")

"""Score, run and project reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import ratio, round_half_up


def score_stats(scores: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """total, rounded average, min and max per group."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("total"),
        round_half_up(F.avg("overall_score")).alias("average"),
        F.min("overall_score").alias("min_score"),
        F.max("overall_score").alias("max_score"),
    )


def score_stats_for_all(projects: DataFrame, scores: DataFrame) -> DataFrame:
    """Stats of every project; one without scores has total 0, average 0, min 100, max 0."""
    return projects.select("project_id").join(score_stats(scores), "project_id", "left").na.fill(
        {"total": 0, "average": 0, "min_score": 100, "max_score": 0}
    )


def stats_by_page_type(scores: DataFrame) -> DataFrame:
    return scores.groupBy("project_id", "page_type").agg(
        F.count("*").alias("total"), round_half_up(F.avg("overall_score")).alias("average")
    )


def snapshot_stats(snapshots: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """2xx is successful, 400 and above failed, anything else neither."""
    code = F.col("status_code")
    return snapshots.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if((code >= 200) & (code < 300)).alias("successful"),
        F.count_if(code >= 400).alias("failed"),
    )


def counts_per(parents: DataFrame, key: str, children: Mapping[str, DataFrame]) -> DataFrame:
    """Parents with a count of each child table; children are counted before the join, so nothing fans out."""
    out = parents
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left")
    return out.na.fill(0, list(children))


def category_averages(scores: DataFrame, category: Column, key: str = "score_id") -> DataFrame:
    """Rounded mean of the criteria of each category, per score."""
    exploded = scores.select(key, F.explode("criteria_scores").alias("criterion", "score"))
    return exploded.groupBy(key, category.alias("category")).agg(
        round_half_up(F.avg("score")).alias("average"), F.count("*").alias("criteria")
    )


def scoring_summary(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Columns hit (bool), tokens, failed (bool) -> scores created, cache hits, hit rate, tokens, errors."""
    return items.groupBy(*by).agg(
        F.count_if(~F.col("failed")).alias("scores_created"),
        F.count_if(F.col("hit") & ~F.col("failed")).alias("cache_hits"),
        F.sum(F.when(F.col("hit") | F.col("failed"), F.lit(0)).otherwise(F.col("tokens"))).alias("tokens_used"),
        F.count_if("failed").alias("errors"),
        F.count("*").alias("_n"),
    ).withColumn("hit_rate", ratio(F.col("cache_hits"), F.col("_n"), 100.0)).drop("_n")


def progress(processed: Column, discovered: Column) -> Column:
    return F.when(discovered > 0, round_half_up(processed / discovered * 100)).otherwise(F.lit(0))


def queue_health(items: DataFrame, paused: Column | None = None) -> DataFrame:
    """Health per queue from work items (queue, state): paused, critical, degraded or healthy."""
    stats = items.groupBy("queue").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "active").alias("active"),
        F.count_if(F.col("state") == "waiting").alias("waiting"),
    )
    failure, active = ratio(F.col("failed"), F.col("total"), 100.0), ratio(F.col("active"), F.col("total"), 100.0)
    stop = F.lit(False) if paused is None else paused
    health = (
        F.when(stop, F.lit("paused"))
        .when(failure > 50, F.lit("critical"))
        .when((failure > 20) | (F.col("waiting") > 1000), F.lit("degraded"))
        .otherwise(F.lit("healthy"))
    )
    return stats.withColumns({"failure_rate": failure, "active_rate": active, "health": health})


def system_health(queues: DataFrame) -> DataFrame:
    """Worst of critical > degraded > healthy over all queues."""
    rank = F.when(F.col("health") == "critical", 2).when(F.col("health") == "degraded", 1).otherwise(0)
    worst = F.max(rank)
    return queues.agg(
        F.when(worst == 2, F.lit("critical")).when(worst == 1, F.lit("degraded")).otherwise(F.lit("healthy")).alias("overall_health"),
        F.count("*").alias("queues"),
    )


def usage_counters(requests: DataFrame, by: Sequence[str] = ("endpoint", "method")) -> DataFrame:
    return requests.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status_code") < 400).alias("success"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
    )


def priority_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per priority and the distinct categories (a fixed vocabulary) of recommendations."""
    return findings.groupBy(*by).agg(
        *[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium", "low")],
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )


def daily_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by, F.to_date("scored_at").alias("day")).agg(
        F.count("*").alias("scores"), round_half_up(F.avg("overall_score")).alias("average")
    )


def confusion(df: DataFrame, expected: str, actual: str) -> DataFrame:
    return df.groupBy(expected, actual).agg(F.count("*").alias("n"))


def outcomes(items: DataFrame) -> DataFrame:
    """Batch outcome: items, failures and each error message's count."""
    return items.groupBy(F.col("error").isNull().alias("success"), F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def pages_with_score(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Pages left-joined to their current score."""
    current = scores.select(F.col("score_id").alias("current_score_id"), "overall_score", "scored_at")
    return pages.join(current, "current_score_id", "left")


def order_pages(df: DataFrame, sort: str, descending: bool, tie: str = "page_id") -> DataFrame:
    """Sort by a column; a missing score counts as 0, a missing date as the epoch."""
    kind = df.schema[sort].dataType.typeName()
    key = F.col(sort)
    if kind in ("integer", "long", "double", "float"):
        key = F.coalesce(key, F.lit(0))
    elif kind in ("timestamp", "timestamp_ntz", "date"):
        key = F.coalesce(key, F.lit("1970-01-01").cast(kind))
    else:
        key = F.coalesce(key, F.lit(""))
    return df.orderBy(key.desc() if descending else key.asc(), tie)


def page_of(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame."""
    return df.offset((number - 1) * size).limit(size)


def after_key(df: DataFrame, sort: str, tie: str, last_sort, last_tie, size: int, descending: bool = True) -> DataFrame:
    """Keyset paging for deep pages: rows after the last one shown; a filter, so nothing is skipped over."""
    s, t = F.col(sort), F.col(tie)
    beyond = (s < last_sort if descending else s > last_sort) | ((s == last_sort) & (t > last_tie))
    return df.filter(beyond).orderBy(s.desc() if descending else s.asc(), t).limit(size)


def lowest_pages(pages: DataFrame, n: int) -> DataFrame:
    return pages.filter("overall_score is not null").orderBy("overall_score", "page_id").limit(n)

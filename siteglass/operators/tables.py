"""Records of the tables, and appending them. Changes of stored tables: :mod:`.store`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.numbers import round_half_up

# --- fixed values -------------------------------------------------------------
CRITERIA = (
    "direct_answer", "question_coverage", "eeat_signals", "outbound_links", "schema_markup", "internal_linking",
    "readability", "performance", "indexing", "accessibility", "content_freshness", "conversational_tone",
    "snippet_optimization", "original_research", "multimedia_richness", "entity_clarity",
)
RUN_STATUSES = ("queued", "running", "paused", "completed", "failed")
ENDED = ("completed", "failed")
# --------------------------------------------------------------------------------


def content_hash(text: Column, empty_is_null: bool = False) -> Column:
    """SHA-256 of a text; a missing text hashes as '' or, with ``empty_is_null``, has no hash."""
    if empty_is_null:
        return F.when(F.coalesce(text, F.lit("")) != "", F.sha2(text, 256))
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Fill missing columns and null cells."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in have else d for c, d in defaults.items()})


def snapshot_rows(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Complete snapshot records: content hash, default status and metrics."""
    filled = with_defaults(df, {"status_code": F.lit(200), "render_method": F.lit("static")})
    return filled.withColumn("content_hash", content_hash(F.col(text)))


def page_rows(df: DataFrame, url: str = "url") -> DataFrame:
    """Storage form of the URL and its hash, the unique key of a page within a project."""
    return df.withColumn(url, U.normalize_storage(F.col(url))).withColumn("url_hash", U.url_hash(F.col(url)))


def overall_score(criteria: Column) -> Column:
    """Rounded unweighted mean of a criteria map; an empty map scores 0."""
    values = F.filter(F.map_values(criteria), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(round_half_up(F.when(F.size(values) > 0, total / F.size(values))), F.lit(0))


def merge_criteria(criteria: Column, names: Sequence[str] = CRITERIA) -> Column:
    """Criteria map with every known criterion present (0 where not given); unknown names are kept."""
    given = F.coalesce(criteria, F.create_map().cast("map<string,int>"))
    known = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(*[F.coalesce(F.try_element_at(given, F.lit(n)), F.lit(0)) for n in names]),
    )
    return F.map_concat(known, F.map_filter(given, lambda k, v: ~k.isin(*names)))


def score_rows(df: DataFrame, criteria: str = "criteria_scores") -> DataFrame:
    """Score records: merged criteria, overall score, zero tokens where unknown."""
    merged = df.withColumn(criteria, merge_criteria(F.col(criteria)))
    return with_defaults(merged, {"ai_tokens_used": F.lit(0)}).withColumn("overall_score", overall_score(F.col(criteria)))


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a parquet table. Rows of a partition value are brought together, and adaptive execution deals them into files by
    size: a hot value stays parallel, and small ones do not become a file for each task."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("append").partitionBy(*partition_by).parquet(path)

"""Predicates and small projections of the reporting side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -------------------------------------------------------------------
SCORE_BANDS = ((80, "Excellent"), (60, "Good"), (40, "Fair"))
RESULT_BANDS = ((80, "Excellent"), (60, "Good"), (40, "Needs Work"))
ROLES = ("viewer", "editor", "admin")
# --------------------------------------------------------------------------------------


def equals_any(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Keyed lookup of many keys."""
    return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin("queued", "running"))


def in_score_range(
    low: float | None = None, high: float | None = None, page_type: str | None = None, score: str = "overall_score"
) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(score) >= low)
    if high is not None:
        ok = ok & (F.col(score) <= high)
    if page_type is not None:
        ok = ok & (F.col("page_type") == page_type)
    return ok


def stale(as_of: Column, days: int = 7, column: str = "last_crawled_at") -> Column:
    return F.col(column).isNull() | (F.col(column) < as_of - F.make_dt_interval(F.lit(days)))


def stale_pages(pages: DataFrame, as_of: Column, days: int = 7, limit: int = 100) -> DataFrame:
    """Pages to revisit, oldest discovery first."""
    return pages.filter(stale(as_of, days)).orderBy("first_discovered_at", "page_id").limit(limit)


def name_contains(column: str, term: str) -> Column:
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{escaped}%")


def page_table_filter(
    search: str = "", page_type: str = "all", low: int | None = None, high: int | None = None
) -> Column:
    """Interactive filter of a page list: an unscored page never passes a score bound."""
    ok = F.lit(True)
    if search:
        term = search.lower()
        ok = F.coalesce(F.lower("url").contains(term), F.lit(False)) | F.coalesce(F.lower("title").contains(term), F.lit(False))
    if page_type != "all":
        ok = ok & (F.col("page_type") == page_type)
    if low is not None or high is not None:
        scored = F.col("overall_score").isNotNull() & F.col("scored_at").isNotNull()
        ok = ok & scored & in_score_range(low, high)
    return ok


def score_band(score: Column, bands: Sequence[tuple[int, str]] = SCORE_BANDS) -> Column:
    out = F.when(score >= bands[0][0], F.lit(bands[0][1]))
    for floor, name in bands[1:]:
        out = out.when(score >= floor, F.lit(name))
    return out.otherwise(F.lit("Poor"))


def run_list_filter(choice: str) -> Column:
    """all / running (queued included) / completed / failed; anything else shows all."""
    wanted = {"running": ("running", "queued"), "completed": ("completed",), "failed": ("failed",)}
    return F.col("status").isin(*wanted[choice]) if choice in wanted else F.lit(True)


def recommendation_filter(priority: str = "all", category: str = "all") -> Column:
    ok = F.lit(True)
    if priority != "all":
        ok = ok & (F.col("priority") == priority)
    if category != "all":
        ok = ok & (F.col("category") == category)
    return ok


def relative_age(at: Column, as_of: Column) -> Column:
    """"3 hours ago"; a date from a week on, "N/A" where unknown."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))

    def ago(unit_seconds: int, unit: str) -> Column:
        n = F.floor(seconds / unit_seconds)
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))

    return (
        F.when(at.isNull(), F.lit("N/A"))
        .when(seconds < 60, F.lit("Just now"))
        .when(seconds < 3600, ago(60, "minute"))
        .when(seconds < 86400, ago(3600, "hour"))
        .when(seconds < 7 * 86400, ago(86400, "day"))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def slower_than(threshold: float = 1000.0, column: str = "duration_ms") -> Column:
    return F.col(column) > threshold


def thin_page(words: str = "word_count", minimum: int = 200) -> Column:
    return F.col(words) < minimum


def role_rank(role: Column) -> Column:
    """viewer 1 < editor 2 < admin 3; 0 for anything else."""
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), role).cast("int")


def at_least(role: Column, minimum: str) -> Column:
    return F.coalesce(role_rank(role) >= ROLES.index(minimum) + 1, F.lit(False))

"""Validation: each rule yields messages in an ``errors`` column instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import CRITERIA, RUN_STATUSES

# --- fixed values ---------------------------------------------------------------
EMAIL = r"(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z|]{2,}$"
ARRAY_FIELDS = ("headings", "faq", "internal_links", "outbound_links", "schema_types")
# ----------------------------------------------------------------------------------


def collect_errors(*checks: tuple[Column, str | Column]) -> Column:
    """Messages of the (failed condition, message) pairs that hold."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for bad, m in checks]
    return F.array_compact(F.array(*found))


def criteria_errors(criteria: Column) -> Column:
    """Unknown names, missing numbers, values outside 0-100."""
    entries = F.map_entries(criteria)

    def of_entry(e: Column) -> Column:
        name, value = e["key"], e["value"]
        return F.array_compact(F.array(
            F.when(~name.isin(*CRITERIA), F.concat(F.lit("Invalid criterion: "), name)),
            F.when(value.isNull(), F.concat(name, F.lit(" must be a number"))),
            F.when((value < 0) | (value > 100), F.concat(name, F.lit(" must be between 0 and 100"))),
        ))

    missing = F.array(F.lit("criteria_scores must be an object"))
    return F.when(criteria.isNull(), missing).otherwise(F.flatten(F.transform(entries, of_entry)))


def recommendation_errors(recs: Column) -> Column:
    """``recs`` is array<struct<category, text, references>>."""

    def of_item(r: Column, i: Column) -> Column:
        at = F.concat(F.lit("Recommendation at index "), i.cast("string"))
        return F.array_compact(F.array(
            F.when(F.coalesce(r["category"], F.lit("")) == "", F.concat(at, F.lit(" must have a category (string)"))),
            F.when(F.coalesce(r["text"], F.lit("")) == "", F.concat(at, F.lit(" must have text (string)"))),
        ))

    missing = F.array(F.lit("ai_recommendations must be an array"))
    return F.when(recs.isNull(), missing).otherwise(F.flatten(F.transform(recs, of_item)))


def score_warnings(overall: Column, criteria: Column, recs: Column) -> Column:
    """Soft checks of a finished score."""
    high = F.filter(F.map_entries(criteria), lambda e: (e["value"] < 0) | (e["value"] > 100))

    def of_item(r: Column, i: Column) -> Column:
        at = F.concat(F.lit("Recommendation "), i.cast("string"))
        return F.array_compact(F.array(
            F.when(F.length(F.coalesce(r["text"], F.lit(""))) < 20, F.concat(at, F.lit(" too short"))),
            F.when(F.coalesce(F.size(r["references"]), F.lit(0)) <= 0, F.concat(at, F.lit(" missing references"))),
        ))

    return F.concat(
        collect_errors(((overall < 0) | (overall > 100), "Overall score out of range")),
        F.transform(high, lambda e: F.concat(F.lit("Criterion "), e["key"], F.lit(" score out of range"))),
        F.flatten(F.transform(recs, of_item)),
    )


def extraction_errors(extraction: Column) -> Column:
    """``extraction`` is a VARIANT: array fields that are given must be arrays."""
    text = F.to_json(extraction)
    wrong = [
        (F.schema_of_variant(F.try_variant_get(extraction, f"$.{f}", "variant")).rlike("^(?!ARRAY|VOID)"), f"extraction.{f} must be an array")
        for f in ARRAY_FIELDS
    ]
    return collect_errors((extraction.isNull() | ~text.startswith("{"), "extraction must be an object"), *wrong)


def config_errors(depth: Column, sample: Column, tokens: Column) -> Column:
    return collect_errors(
        (~depth.between(1, 10), "depth_limit must be between 1 and 10"),
        (sample <= 0, "sample_size must be greater than 0"),
        (tokens <= 0, "token_limit must be greater than 0"),
    )


def run_errors(status: Column, processed: Column, discovered: Column) -> Column:
    return collect_errors(
        (~status.isin(*RUN_STATUSES), "status must be one of: " + ", ".join(RUN_STATUSES)),
        ((processed > discovered) & (processed != 0) & (discovered != 0), "pages_processed cannot exceed pages_discovered"),
    )


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(EMAIL), F.lit(False))


def error_report(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Message counts over all rows."""
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))

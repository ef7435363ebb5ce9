"""Flagship plan: raw pages -> features -> page type -> scores -> recommendations. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators.features import features, with_page_type
from ..operators.scoring import with_recommendations, with_scores
from ..sources.markup import parse_pages


def analyze_features(pages: DataFrame, load_time: Column | None = None, year: int | None = None, closed_references: bool = False) -> DataFrame:
    return with_page_type(features(parse_pages(pages, closed_references=closed_references), load_time=load_time, year=year))


def analyze(pages: DataFrame, load_time: Column | None = None, year: int | None = None, closed_references: bool = False) -> DataFrame:
    """One row per page with page type, five scores and ranked recommendations."""
    scored = with_recommendations(with_scores(analyze_features(pages, load_time, year, closed_references)))
    return scored.select(
        "page_id", "url", "page_type", "overall_score", "content_score", "eat_score", "technical_score",
        "structured_data_score", "recommendations",
    )

"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune
from . import discovery_queries, page_queries, record_queries, report_queries, stream_queries  # noqa: F401  (register)
from .analysis import analyze
from .bindings import Tables
from .registry import QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    found = analyze(Tables(spark, folder).stored_pages, closed_references=True)
    return found.withColumn("recommendations", F.to_json("recommendations"))

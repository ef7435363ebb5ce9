"""Query registry: name, plan, and the equal SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .bindings import Tables


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return self.plan(Tables(spark, folder.rstrip("/")))


QUERIES: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register a plan for the blueprint rows (e.g. ``"D2 D3"``) it covers."""

    def add(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(rows.split()), plan, sql)
        return plan

    return add

"""Sitemap documents (sitemap_url, xml) -> URL entries and child sitemaps, by ``from_xml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..session import ensure_checkpoint_dir

_ENTRY = "struct<loc:string,lastmod:string,changefreq:string,priority:string>"
_SCHEMA = f"url array<{_ENTRY}>, sitemap array<struct<loc:string,lastmod:string>>"
# Namespaces and prefixes carry no meaning here.
_NAMESPACE = r"\s+xmlns(:[A-Za-z0-9_]+)?=(\"[^\"]*\"|'[^']*')"


def _text(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def _document(docs: DataFrame) -> DataFrame:
    cleaned = F.regexp_replace("xml", _NAMESPACE, "")
    return docs.select("sitemap_url", F.from_xml(cleaned, _SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """sitemap_url, pos, url, lastmod, changefreq, priority. A priority of 0 or no number is null."""
    e = _document(docs).select("sitemap_url", F.posexplode("d.url").alias("pos", "e"))
    loc, number = _text(F.col("e.loc")), F.trim("e.priority").try_cast("double")
    return e.filter(loc.isNotNull()).select(
        "sitemap_url", "pos",
        F.coalesce(U.resolve(loc, F.col("sitemap_url")), loc).alias("url"),
        _text(F.col("e.lastmod")).alias("lastmod"),
        _text(F.col("e.changefreq")).alias("changefreq"),
        F.when(number != 0, number).alias("priority"),
    )


def child_sitemaps(docs: DataFrame) -> DataFrame:
    """sitemap_url, child_url, lastmod of sitemap index documents."""
    e = _document(docs).select("sitemap_url", F.explode("d.sitemap").alias("e"))
    loc = _text(F.col("e.loc"))
    return e.filter(loc.isNotNull()).select(
        "sitemap_url", F.coalesce(U.resolve(loc, F.col("sitemap_url")), loc).alias("child_url"), _text(F.col("e.lastmod")).alias("lastmod")
    )


def reachable_sitemaps(docs: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """(sitemap_url, depth) of every sitemap reached from ``roots`` (sitemap_url), each visited once.

    Breadth first: an index reached again deeper keeps its first depth. Each round is
    checkpointed, so lineage does not grow with depth.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    edges = child_sitemaps(docs).select("sitemap_url", "child_url").distinct().checkpoint()
    seen = roots.select("sitemap_url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = (
            frontier.select("sitemap_url").join(edges, "sitemap_url").select(F.col("child_url").alias("sitemap_url"))
            .distinct().join(seen, "sitemap_url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        )
        if step.isEmpty():
            break
        seen = seen.unionByName(step).checkpoint()
        frontier = step
    return seen


def filter_urls(urls: DataFrame, modified_after: Column | None = None, min_priority: float | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Entries without a date (or priority) pass the date (or priority) filter; an unreadable date does not."""
    out = urls
    if modified_after is not None:
        out = out.filter(F.col("lastmod").isNull() | (F.try_to_timestamp("lastmod") >= modified_after))
    if min_priority is not None:
        out = out.filter(F.col("priority").isNull() | (F.col("priority") >= min_priority))
    return out.filter(U.passes_patterns(F.col("url"), exclude=exclude))


def sitemap_stats(urls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p = F.col("priority")
    return urls.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count("priority").alias("with_priority"),
        F.count("lastmod").alias("with_lastmod"),
        F.count("changefreq").alias("with_changefreq"),
        F.count_if(p >= 0.8).alias("high"),
        F.count_if((p >= 0.5) & (p < 0.8)).alias("medium"),
        F.count_if(p < 0.5).alias("low"),
    )


def changefreq_histogram(urls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return urls.filter("changefreq is not null").groupBy(*by, "changefreq").agg(F.count("*").alias("n"))

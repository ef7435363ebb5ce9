"""Robots files (host, robots_txt) -> sitemap lines, disallowed paths, crawl delay.

A robots file is one row, so its lines are worked on as an array inside the row: no window
over a host and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_DELAY = 1.0


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))


def _directive(line: Column, name: str) -> Column:
    """Value of ``name: value``, else null."""
    return F.when(F.lower(line).startswith(name + ":"), F.trim(F.substring(line, F.lit(len(name) + 2), F.length(line))))


def _with_agent(text: Column) -> Column:
    """Lines labelled with the user agent they stand under: array<struct<line, agent>>."""
    start = F.array().cast("array<struct<line:string,agent:string>>")

    def step(acc: Column, line: Column) -> Column:
        agent = F.coalesce(_directive(line, "user-agent"), F.get(F.slice(acc, -1, 1), F.lit(0))["agent"])
        return F.concat(acc, F.array(F.struct(line.alias("line"), agent.alias("agent"))))

    # Only directive lines matter; comments and blank lines are dropped first, so the fold stays short.
    relevant = F.filter(_lines(text), lambda x: F.lower(x).rlike(r"^(user-agent|disallow|crawl-delay):"))
    return F.aggregate(relevant, start, step)


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """host, pos, sitemap_url."""
    lines = F.filter(F.transform(F.split("robots_txt", "\n"), lambda x: F.trim(F.regexp_extract(x, r"^(?i)sitemap:\s*(.+)$", 1))), lambda x: x != "")
    return files.select("host", F.posexplode(F.array_distinct(lines)).alias("pos", "sitemap_url"))


def disallowed_paths(files: DataFrame, agent: str = "*") -> DataFrame:
    """host, pos, path: rules under ``agent`` or ``*``; an empty rule or ``/`` alone is left out."""
    rules = F.filter("labelled", lambda x: x["agent"].isin(agent, "*") & F.coalesce(~_directive(x["line"], "disallow").isin("", "/"), F.lit(False)))
    return (
        files.withColumn("labelled", _with_agent(F.col("robots_txt")))
        .select("host", F.posexplode(F.transform(rules, lambda x: _directive(x["line"], "disallow"))).alias("pos", "path"))
    )


def crawl_delays(files: DataFrame, agent: str = "*") -> DataFrame:
    """host, crawl_delay: the agent's own delay, else the one for all agents, else 1."""

    def delay(name: str) -> Column:
        own = F.filter("labelled", lambda x: (F.lower(x["agent"]) == name.lower()) & _directive(x["line"], "crawl-delay").isNotNull())
        return F.get(F.transform(own, lambda x: _directive(x["line"], "crawl-delay").try_cast("double")), F.lit(0))

    def truthy(x: Column) -> Column:
        return F.when(x != 0, x)

    return files.withColumn("labelled", _with_agent(F.col("robots_txt"))).select(
        "host", F.coalesce(truthy(delay(agent)), truthy(delay("*")), F.lit(DEFAULT_DELAY)).alias("crawl_delay")
    )


def path_allowed(path: Column, rules: Column) -> Column:
    """``rules`` is an array of path prefixes; a trailing ``*`` is the same prefix without it."""
    blocked = F.exists(rules, lambda r: path.startswith(F.regexp_replace(r, r"\*$", "")))
    return ~F.coalesce(blocked, F.lit(False))


def with_rules(urls: DataFrame, files: DataFrame, agent: str = "*") -> DataFrame:
    """URLs (with ``host``) plus ``allowed``. A host's rules stay one array of one robots file."""
    labelled = files.withColumn("labelled", _with_agent(F.col("robots_txt")))
    kept = F.filter("labelled", lambda x: x["agent"].isin(agent, "*") & F.coalesce(~_directive(x["line"], "disallow").isin("", "/"), F.lit(False)))
    rules = labelled.select("host", F.transform(kept, lambda x: _directive(x["line"], "disallow")).alias("_rules"))
    return urls.join(rules, "host", "left").withColumn("allowed", path_allowed(F.col("path"), F.col("_rules"))).drop("_rules")


def excluded_report(urls: DataFrame, by: str) -> DataFrame:
    """URLs kept out by robots rules, per run."""
    return urls.groupBy(by).agg(F.count_if(~F.col("allowed")).alias("excluded"), F.count("*").alias("total"))

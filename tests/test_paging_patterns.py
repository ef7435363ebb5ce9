"""Deep pages and pattern tables against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from siteglass.operators import paging, patterns


def test_pages_of_a_sorted_list(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, 5, 5, 5, r.randrange(50)])) for i in range(1000)]  # many ties
    frame = spark.createDataFrame(rows, "id long, score int").repartition(5)
    listed = paging.sorted_list(frame, [F.col("score").desc_nulls_last(), F.col("id").asc()], partitions=7)
    want = [i for i, _ in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    assert listed.rows == 1000 and len(listed.starts) == 8
    for number, size in ((1, 10), (4, 130), (50, 20), (8, 130), (1, 5000), (333, 3)):
        got = {x["rank"]: x["id"] for x in listed.page(number, size).collect()}
        assert [got[k] for k in sorted(got)] == want[(number - 1) * size:number * size]
        assert sorted(got) == list(range((number - 1) * size + 1, min(1000, number * size) + 1))
    assert listed.page(51, 20).collect() == [] and paging.sorted_list(frame.limit(0), [F.col("id").asc()]).page(1, 5).collect() == []
    with pytest.raises(ValueError):
        listed.page(0, 5)
    plan = listed.page(50, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan.replace("isnotnull(_part", "_part") or "_part" in plan.split("PartitionFilters")[1]


def test_literal_parts():
    parts = patterns.literal_parts
    assert parts("/blog/") == ["/blog/"] and parts(r"^/blog/\d+$") == ["/blog/"] and parts("(?:news|blog)/x") == ["/x"]
    assert parts("/(faq)s?/end") == ["/faq", "/end"] and parts("(abc)+d") == ["abc", "d"] and parts("(abc)*d") == ["d"]
    assert parts("(?i)/BLOG") == ["/blog"] and parts("a|b") == [] and parts("(unclosed") == [] and parts("É1") == []


@pytest.mark.parametrize("limit", [0, 20_000])
def test_first_match_of_a_thousand_patterns(spark, monkeypatch, limit):
    monkeypatch.setattr(patterns, "BROADCAST_PATTERNS", limit)
    r = random.Random(limit)
    words = [a + b for a in ("blog", "shop", "faq", "help", "news") for b in ("", "s", "-de", "-en", "42")]
    made = [f"/{r.choice(words)}/{r.choice(words)}" if r.random() < 0.5 else f"{r.choice(words)}/?(\\d+|{r.choice(words)})$" for _ in range(1000)]
    made += [r"\d\d\d$", "(?i)/SHOP/", "x|/faq/", None, "^$"]
    table = [(i, p, f"t{i % 7}", r.randrange(40)) for i, p in enumerate(made)]
    urls = [f"https://Site{r.randrange(9)}.com/{r.choice(words)}/{r.choice(words)}" + r.choice(["", "/", str(r.randrange(2000))]) for _ in range(150)] + [None, "", "a"]
    got = {x["url"]: (x["page_type"], x["pattern_id"]) for x in patterns.first_matches(
        spark.createDataFrame([(u,) for u in urls + urls[:9]], "url string"), spark.createDataFrame(table, "pattern_id long, pattern string, page_type string, priority int")).collect()}
    want = {}
    for u in urls:
        found = min(((p, i, t) for i, x, t, p in table if x is not None and u is not None and re.search(x, u)), default=None)
        want[u] = (found[2], found[1]) if found else ("unknown", None)
    assert got == want


def test_no_nested_loop(spark):
    made = patterns.first_matches(spark.createDataFrame([("https://a.b/c",)], "url string"), spark.createDataFrame([(1, "/c", "x", 1)], "pattern_id long, pattern string, page_type string, priority int"))
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in made._jdf.queryExecution().executedPlan().toString()


def test_many_patterns_are_never_broadcast(spark, monkeypatch):
    """Small by Spark's estimate, as a table computed from one narrow column is; equal patterns go down to one first."""
    monkeypatch.setattr(patterns, "BROADCAST_PATTERNS", 3)
    n = F.col("id")
    made = spark.range(1000).select(n.alias("pattern_id"), F.concat(F.lit("/page/[0-9]*"), (n % 50 + 10).cast("string"), F.lit("$")).alias("pattern"),
                                    F.concat(F.lit("t"), (n % 7).cast("string")).alias("page_type"), (n * 37 % 101).alias("priority"))
    urls = spark.range(300).select(F.concat(F.lit("https://a.b/page/"), n.cast("string")).alias("url"))
    found = patterns.first_matches(urls, made)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    best = {}
    for i in range(1000):
        best[i % 50 + 10] = min(best.get(i % 50 + 10, (999, 0)), (i * 37 % 101, i))
    want = {f"https://a.b/page/{k}": (f"t{best[k % 100][1] % 7}", best[k % 100][1]) if k % 100 in best else ("unknown", None) for k in range(300)}
    assert {x.url: (x.page_type, x.pattern_id) for x in found.collect()} == want
    assert patterns.least_of_equals(made).count() == 50

"""Sitemaps, robots files, crawl planning, link graph, vectors."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from siteglass.operators import links, vectors
from siteglass.sources import robots, sitemaps


def test_sitemap_parsing(spark):
    urlset = """<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:x="http://x">
    <url><loc> /rel?a=1&amp;b=2 </loc><lastmod>2024-01-01</lastmod><changefreq>daily</changefreq><priority>0.8</priority></url>
    <url><loc>https://o.com/x</loc><priority>0.0</priority></url><url><loc></loc></url><url><loc>https://o.com/y</loc><priority>abc</priority></url></urlset>"""
    docs = spark.createDataFrame([("https://e.com/maps/s.xml", urlset)], "sitemap_url string, xml string")
    got = [tuple(r)[2:] for r in sitemaps.sitemap_urls(docs).orderBy("pos").collect()]
    assert got == [("https://e.com/rel?a=1&b=2", "2024-01-01", "daily", 0.8), ("https://o.com/x", None, None, None), ("https://o.com/y", None, None, None)]


def test_sitemap_walk_survives_cycles(spark):
    def index(*children):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>https://e.com/{c}</loc></sitemap>" for c in children) + "</sitemapindex>"

    docs = spark.createDataFrame([
        ("https://e.com/a", index("b", "c", "a")), ("https://e.com/b", index("c", "a", "d")), ("https://e.com/c", "<urlset/>"), ("https://e.com/d", index("e")),
    ], "sitemap_url string, xml string")
    roots = docs.filter("sitemap_url = 'https://e.com/a'")
    got = {r["sitemap_url"][-1]: r["depth"] for r in sitemaps.reachable_sitemaps(docs, roots).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r["sitemap_url"][-1] for r in sitemaps.reachable_sitemaps(docs, roots, max_depth=1).collect()} == {"a", "b", "c"}


def test_sitemap_filter(spark):
    urls = spark.createDataFrame([("u1", "2024-02-01", 0.9), ("u2", None, None), ("u3", "2023-01-01", 0.9), ("u4", "bad", 0.9), ("u5", None, 0.1), ("x6", None, None)], "url string, lastmod string, priority double")
    got = sitemaps.filter_urls(urls, F.lit("2024-01-01").cast("timestamp"), 0.5, ["x"])
    assert sorted(r["url"] for r in got.collect()) == ["u1", "u2"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private*\nDisallow: /\nDisallow:\nCrawl-delay: 3\n# c\nUser-agent: other\nDisallow: /o\nUser-agent: me\nDisallow: /mine\nSitemap: https://e.com/s.xml\n"
    files = spark.createDataFrame([("e.com", text), ("f.com", "")], "host string, robots_txt string")
    assert [r["path"] for r in robots.disallowed_paths(files, "me").orderBy("pos").collect()] == ["/private*", "/mine"]
    assert {r["host"]: r["crawl_delay"] for r in robots.crawl_delays(files, "me").collect()} == {"e.com": 3.0, "f.com": 1.0}
    assert [r["sitemap_url"] for r in robots.robots_sitemaps(files).collect()] == ["https://e.com/s.xml"]
    urls = spark.createDataFrame([("e.com", "/private-x"), ("e.com", "/open"), ("e.com", "/mine/1"), ("g.com", "/private")], "host string, path string")
    got = {(r["host"], r["path"]): r["allowed"] for r in robots.with_rules(urls, files, "me").collect()}
    assert got == {("e.com", "/private-x"): False, ("e.com", "/open"): True, ("e.com", "/mine/1"): False, ("g.com", "/private"): True}


def _queue(spark):
    entries = spark.createDataFrame([(1, "https://e.com/b", 0, 0.9), (1, "https://e.com/c/", 1, None), (1, "https://e.com/c", 2, 0.7), (1, "https://e.com/skip", 3, 1.0)], "run_id int, url string, pos long, priority double")
    return links.discovery_queue(entries, spark.createDataFrame([(1, "https://e.com/")], "run_id int, url string"), ["skip"])


def test_queue_order_and_sample(spark):
    queue = _queue(spark)
    order = [(r["url"], r["priority"]) for r in links.in_visit_order(queue).orderBy("visit").collect()]
    assert order == [("https://e.com/", 1.0), ("https://e.com/b", 0.9), ("https://e.com/c", 0.5)]
    assert links.sample(queue, 2).count() == 2 and links.sample(queue, None).count() == 3


def test_frontier_and_modes(spark):
    pages = spark.createDataFrame([
        ("https://e.com/", "e.com", ["https://e.com/b", "https://e.com/d", "https://sub.e.com/x"]), ("https://e.com/d", "e.com", ["https://e.com/f", "https://e.com/"]),
        ("https://e.com/f", "e.com", ["https://e.com/g"]), ("https://e.com/c", "e.com", ["https://e.com/bad/1"]),
    ], "url string, host string, l array<string>")
    extracted = pages.select(F.lit(1).alias("page_id"), "url", "host", F.transform("l", lambda x: F.struct(x.alias("url"), F.lit("").alias("anchor"))).alias("internal_links"))
    queue = _queue(spark)
    got = {r["node"][13:]: r["depth"] for r in links.crawl_frontier(extracted, queue, 2, ["bad"]).collect()}
    assert got == {"/": 0, "/b": 0, "/c": 0, "/d": 1, "/f": 2}
    assert links.select_urls("sitemap_only", queue).count() == 3
    assert links.select_urls("full", queue, extracted, 1).count() == 5
    bases = spark.createDataFrame([(1, "https://e.com/")], "run_id int, url string")
    assert [r["url"] for r in links.select_urls("sample", queue, sample_size=1, strict=True, bases=bases).collect()] == ["https://e.com/"]
    two = queue.unionByName(queue.withColumn("run_id", F.lit(2)).filter("url like '%b'"))
    both = {(r["run_id"], r["url"][13:], r["depth"]) for r in links.select_urls("full", two, extracted, 2, exclude=["bad"]).collect()}
    assert both == {(1, "/", 0), (1, "/b", 0), (1, "/c", 0), (1, "/d", 1), (1, "/f", 2), (2, "/b", 0)}
    first = {(r["run_id"], r["url"][13:]) for r in links.select_urls("sample", two, extracted, 2, sample_size=1).collect()}
    assert first == {(1, "/"), (2, "/b")}
    priorities = {r["url"][13:]: r["priority"] for r in links.discovered(extracted, queue, 2, ["bad"]).collect()}
    assert priorities == {"/": 1.0, "/b": 0.9, "/c": 0.5, "/d": 0.3, "/f": 0.3}
    changed = spark.createDataFrame([("https://e.com/b",)], "url string")
    assert [r["url"] for r in links.select_urls("delta", queue, changed=changed).collect()] == ["https://e.com/b"]


def test_canonical_chains(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 11), (20, 10), (30, 4), (40, 40), (41, 40)], "node int, target int")
    got = {r["node"]: (r["final"], r["cyclic"]) for r in links.final_canonical(chain).collect()}
    assert got == {1: (4, False), 2: (4, False), 3: (4, False), 4: (4, False), 30: (4, False), 10: (11, True), 11: (11, True), 12: (11, True), 20: (11, True), 40: (40, False), 41: (40, False)}


def test_long_chains_and_cycles_against_a_walk(spark):
    rng = random.Random(11)
    target = {i: rng.randrange(300) for i in range(300) if rng.random() < 0.97}
    target.update({1000 + i: 1001 + i for i in range(70)})  # a long chain to an end
    target.update({2000 + i: 2000 + (i + 1) % 6 for i in range(6)})  # a cycle of six

    def walk(n):
        seen = []
        while n in target and n not in seen and target[n] != n:
            seen.append(n)
            n = target[n]
        return (n, False) if target.get(n, n) == n else (min(seen[seen.index(n):]), True)

    got = {r["node"]: (r["final"], r["cyclic"]) for r in links.final_canonical(spark.createDataFrame(list(target.items()), "node int, target int")).collect()}
    assert got == {n: walk(n) for n in set(target) | set(target.values())}


def test_tails_of_all_lengths_into_cycles(spark):
    """Ids that rise, fall or are mixed along tails of 1 to 500 nodes, into cycles of 1 to 50."""
    rng, target, final, base = random.Random(4), {}, {}, 0
    for tail, cycle in ((1, 2), (4, 2), (5, 1), (33, 7), (100, 50), (257, 3), (500, 50)):
        for shape in ("rising", "falling", "mixed"):
            ids = list(range(base, base + tail + cycle))
            base += 1000
            if shape == "falling":
                ids.reverse()
            elif shape == "mixed":
                rng.shuffle(ids)
            for a, b in zip(ids, [*ids[1:], ids[tail]]):
                target[a] = b
            final.update({n: (min(ids[tail:]), cycle > 1) for n in ids})
    got = {r["node"]: (r["final"], r["cyclic"]) for r in links.final_canonical(spark.createDataFrame(list(target.items()), "node int, target int")).collect()}
    assert got == final


def test_orphans_and_inbound(spark):
    edges = spark.createDataFrame([("https://e.com/a/",), ("https://e.com/a/",), ("https://e.com/b",)], "target string")
    pages = spark.createDataFrame([(1, "https://e.com/a"), (2, "https://e.com/z")], "page_id int, url string")
    assert [r["page_id"] for r in links.orphans(pages, edges).collect()] == [2]
    assert {r["target"][-2:]: r["inbound"] for r in links.inbound_counts(edges).collect()} == {"a/": 2, "/b": 1}


@pytest.mark.parametrize("blocks", [(1000, 1000), (17, 3)])
def test_top_related_is_exact(spark, blocks):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(99, [0.0] * 6)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v) for i, v in rows[:8]], "query_id long, vector array<double>")
    got: dict = {}
    for r in vectors.top_related(base, queries, 4, block_rows=blocks[0], query_rows=blocks[1]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["similarity"], 9)))

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for q, v in rows[:8]:
        want = sorted(((-cos(v, w), i) for i, w in rows if any(w)))[:4]
        assert got[q] == [(i, round(-s, 9)) for s, i in want]


def test_related_takes_odd_input(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.1]), (2, None), (3, [1.0, 1.0, 1.0]), (4, []), (5, [0.0, 0.0])], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.top_related(base.where("vec_id is not null"), queries, 2, block_rows=2, query_rows=3).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (3, 1): 4}
    assert vectors.top_related(base, queries.limit(0), 2).collect() == []
    assert vectors.top_related(base.limit(0), queries, 2).collect() == []


def test_cosine_column(evaluate):
    row = evaluate([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>", {"c": vectors.cosine(F.col("a"), F.col("b")), "z": vectors.cosine(F.col("a"), F.col("z"))})[0]
    assert row["c"] == pytest.approx(math.sqrt(0.5)) and row["z"] is None


def test_topic_clusters(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(6)] + [(10 + i, [-1.0, 0.01 * i]) for i in range(6)]
    got = {r["vec_id"]: r["topic"] for r in vectors.topic_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()}
    assert len({got[i] for i in range(6)}) == 1 and got[0] != got[10]

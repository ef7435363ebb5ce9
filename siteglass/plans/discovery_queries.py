"""Registered queries over sitemaps, robots files, the link graph and vectors.

Sitemap and robots documents are built by Spark from the page table, in documents of bounded
size, and then parsed by the operators; the SQL computes the expected rows straight from the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import urls as U
from ..operators import extraction as E
from ..operators import cells, history, links, ordered, patterns, vectors
from ..sources import robots, sitemaps
from .bindings import Tables, ctes
from .page_queries import WITH_URLS, _link_sql
from .registry import query

C = F.col


# --- documents derived from the page table -----------------------------------------------------
def _entry_parts():
    p = C("page_id")
    lastmod = F.when(p % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0")))
    priority = F.when(p % 11 == 10, F.lit("1.0")).otherwise(F.concat(F.lit("0."), (p % 11).cast("string")))
    freq = F.element_at(F.array(F.lit("daily"), F.lit("weekly"), F.lit("monthly"), F.lit(None)), (p % 4 + 1).cast("int"))
    return lastmod, priority, freq


def _tagged(name: str, value):
    return F.coalesce(F.concat(F.lit(f"<{name}>"), F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit(f"</{name}>")), F.lit(""))


def sitemap_documents(t: Tables) -> DataFrame:
    """Ten URLs per document, ten documents per index, ten indexes per root."""
    lastmod, priority, freq = _entry_parts()
    entry = F.concat(F.lit("<url>"), _tagged("loc", C("url")), _tagged("lastmod", lastmod), _tagged("changefreq", freq), _tagged("priority", priority), F.lit("</url>"))
    base = F.lit("https://maps.example.com/")

    def name(prefix: str, size: int):
        return F.concat(base, F.lit(prefix), F.floor(C("page_id") / size).cast("string"), F.lit(".xml"))

    def body(tag: str):
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
        return F.concat(F.lit(f'<?xml version="1.0"?><{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), listed, F.lit(f"</{tag}>")).alias("xml")

    leaves = t.raw("pages").select(name("s", 10).alias("sitemap_url"), C("page_id").alias("at"), entry.alias("piece")).groupBy("sitemap_url").agg(body("urlset"))

    def index(child: str, child_size: int, parent: str, parent_size: int) -> DataFrame:
        pairs = t.raw("pages").select(name(parent, parent_size).alias("sitemap_url"), F.floor(C("page_id") / child_size).alias("at"), name(child, child_size).alias("child")).distinct()
        # Every index also lists itself: a cycle the walk has to survive.
        piece = F.concat(F.lit("<sitemap>"), _tagged("loc", C("child")), F.lit("</sitemap><sitemap>"), _tagged("loc", C("sitemap_url")), F.lit("</sitemap>"))
        return pairs.withColumn("piece", piece).groupBy("sitemap_url").agg(body("sitemapindex"))

    return leaves.unionByName(index("s", 10, "i", 100)).unionByName(index("i", 100, "r", 1000))


def robots_files(t: Tables) -> DataFrame:
    """One robots file per host."""
    hosts = t.raw("pages").select(U.host_of(C("url")).alias("host")).distinct()
    delay = (F.length("host") % 4).cast("string")
    text = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /en/1*\nDisallow: /\nDisallow:\nCrawl-delay: "), delay,
        F.lit("\r\n\nUser-agent: otherbot\nDisallow: /fr\n\nuser-agent: sitebot\nDISALLOW: /de\nCrawl-delay: 0\nSitemap: https://"), C("host"),
        F.lit("/sitemap.xml\nsitemap:https://"), C("host"), F.lit("/news.xml\n"),
    )
    return hosts.select("host", text.alias("robots_txt"))


ENTRIES = """e AS (SELECT page_id, url, CASE WHEN page_id % 3 <> 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod,
 CASE page_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' END AS changefreq, CASE WHEN page_id % 11 > 0 THEN (page_id % 11) / 10 END AS priority FROM pages) """


@query("sitemap_entries", "A2", "WITH " + ENTRIES + "SELECT 'https://maps.example.com/s' || (page_id // 10) || '.xml' AS sitemap_url, url, lastmod, changefreq, priority FROM e")
def sitemap_entries(t: Tables):
    return sitemaps.sitemap_urls(sitemap_documents(t)).select("sitemap_url", "url", "lastmod", "changefreq", "priority")


@query("sitemap_walk", "G2", """SELECT 'https://maps.example.com/r' || (page_id // 1000) || '.xml' AS sitemap_url, 0 AS depth FROM pages UNION SELECT 'https://maps.example.com/i' || (page_id // 100) || '.xml', 1 FROM pages
 UNION SELECT 'https://maps.example.com/s' || (page_id // 10) || '.xml', 2 FROM pages""")
def sitemap_walk(t: Tables):
    docs = sitemap_documents(t)
    return sitemaps.reachable_sitemaps(docs, docs.filter(C("sitemap_url").contains("/r")))


@query("sitemap_filter", "B9", "WITH " + ENTRIES + "SELECT page_id, url FROM e WHERE (lastmod IS NULL OR CAST(lastmod AS TIMESTAMP) >= TIMESTAMP '2024-01-15') AND (priority IS NULL OR priority >= 0.4) AND url NOT LIKE '%spam%'")
def sitemap_filter(t: Tables):
    urls = sitemaps.filter_urls(sitemaps.sitemap_urls(sitemap_documents(t)), F.lit("2024-01-15").cast("timestamp"), 0.4, ["spam"])
    page = F.regexp_extract("sitemap_url", "s([0-9]+)", 1).cast("long") * 10 + C("pos")
    return urls.select(page.alias("page_id"), "url")


@query("sitemap_stats", "D5", "WITH " + ENTRIES + """SELECT count(*) AS total, count(priority) AS with_priority, count(lastmod) AS with_lastmod, count(changefreq) AS with_changefreq, count(*) FILTER (priority >= 0.8) AS high,
 count(*) FILTER (priority >= 0.5 AND priority < 0.8) AS medium, count(*) FILTER (priority < 0.5) AS low FROM e""")
def sitemap_stats(t: Tables):
    return sitemaps.sitemap_stats(sitemaps.sitemap_urls(sitemap_documents(t)))


@query("sitemap_changefreq", "D5", "WITH " + ENTRIES + "SELECT changefreq, count(*) AS n FROM e WHERE changefreq IS NOT NULL GROUP BY 1")
def sitemap_changefreq(t: Tables):
    return sitemaps.changefreq_histogram(sitemaps.sitemap_urls(sitemap_documents(t)))


_HOSTS = WITH_URLS + ", h AS (SELECT DISTINCT host FROM f) "


@query("robots_rules", "A3", _HOSTS + "SELECT host, 0 AS pos, '/en/1*' AS path FROM h UNION ALL SELECT host, 1, '/de' FROM h")
def robots_rules(t: Tables):
    return robots.disallowed_paths(robots_files(t), "sitebot")


@query("robots_sitemaps", "A3", _HOSTS + "SELECT host, 0 AS pos, 'https://' || host || '/sitemap.xml' AS sitemap_url FROM h UNION ALL SELECT host, 1, 'https://' || host || '/news.xml' FROM h")
def robots_sitemaps(t: Tables):
    return robots.robots_sitemaps(robots_files(t))


@query("crawl_delays", "A3", _HOSTS + "SELECT host, CASE WHEN length(host) % 4 = 0 THEN 1.0 ELSE length(host) % 4 END AS crawl_delay FROM h")
def crawl_delays(t: Tables):
    return robots.crawl_delays(robots_files(t), "sitebot")


@query("robots_excluded", "B16 D22", WITH_URLS + """SELECT page_id % 10 AS run_id, count(*) FILTER (path0 LIKE '/en/1%' OR path0 LIKE '/de%') AS excluded, count(*) AS total FROM f GROUP BY 1""")
def robots_excluded(t: Tables):
    urls = t.raw("pages").select((C("page_id") % 10).alias("run_id"), U.host_of(C("url")).alias("host"), U.path_of(C("url")).alias("path"))
    return robots.excluded_report(robots.with_rules(urls, robots_files(t), "sitebot"), "run_id")


# --- crawl planning ------------------------------------------------------------------------------
def _queue(t: Tables) -> DataFrame:
    _, priority, _ = _entry_parts()
    entries = t.raw("pages").select((C("page_id") % 5).alias("run_id"), "url", C("page_id").alias("pos"), priority.cast("double").alias("priority"))
    # Run 0 starts from a page its sitemap lists; the others from a page of their own.
    run = (C("page_id") % 5).alias("run_id")
    bases = t.raw("pages").groupBy(run).agg(F.min_by("url", "page_id").alias("u")).select(
        "run_id", F.when(C("run_id") == 0, C("u")).otherwise(F.concat(F.lit("https://base"), C("run_id"), F.lit(".example.com/"))).alias("url")
    )
    return links.discovery_queue(entries, bases, ["spam"])


QUEUE = WITH_URLS + """, q0 AS (SELECT page_id % 5 AS run_id, crawl AS url, page_id + 1 AS pos, CASE WHEN page_id % 11 = 0 THEN 0.5 ELSE (page_id % 11) / 10 END AS priority FROM f WHERE url NOT LIKE '%spam%'
 UNION ALL SELECT DISTINCT page_id % 5, 'https://base' || (page_id % 5) || '.example.com/', 0, 1.0 FROM f WHERE page_id % 5 > 0
 UNION ALL SELECT 0, crawl, 0, 1.0 FROM f WHERE page_id = 0 AND url LIKE '%spam%'),
 q AS (SELECT run_id, url, arg_min(priority, pos) AS priority, min(pos) AS pos FROM q0 GROUP BY run_id, url),
 v AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, pos, sha256(url)) AS visit FROM q) """


@query("visit_order", "E7 G1 E8", QUEUE + "SELECT run_id, url, priority, visit FROM v")
def visit_order(t: Tables):
    return links.in_visit_order(_queue(t)).select("run_id", "url", "priority", "visit")


@query("sampled_queue", "E6 L4", QUEUE + "SELECT run_id, url, visit FROM v WHERE visit <= 7")
def sampled_queue(t: Tables):
    return links.sample(_queue(t), 7).select("run_id", "url", "visit")


@query("delta_urls", "L4 E3", QUEUE + """, c AS (SELECT user_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
 SELECT DISTINCT run_id, url, 0 AS depth FROM q WHERE url IN (SELECT crawl FROM f JOIN c ON user_id = page_id WHERE back = 1 AND changed)""")
def delta_urls(t: Tables):
    # Pages whose latest snapshot differs from the one before.
    last = ordered.latest(history.with_change(t.snapshots), ["page_id"], ["snapshot_at", "snapshot_id"], ["changed"]).filter("changed")
    changed = t.raw("pages").join(last, "page_id").select(U.normalize_crawl(C("url")).alias("url"))
    return links.select_urls("delta", _queue(t), changed=changed).distinct()


def _bare(url: str) -> str:
    return f"regexp_replace(regexp_replace({url}, '#.*$', ''), '([^/])/$', '\\1')"


# Queue and links up to three hops away, per run; links have priority 0.3 and no place in the order of arrival.
DISCOVERED = (QUEUE + ", " + _link_sql(f""", e AS (SELECT DISTINCT {_bare('p.url')} AS src, {_bare('target')} AS dst FROM edges JOIN pages p USING (page_id) WHERE own AND target NOT LIKE '%spam%'),
 walk(run_id, url, depth) AS (SELECT run_id, url, 0 FROM q UNION SELECT run_id, dst, depth + 1 FROM walk JOIN e ON src = url WHERE depth < 3),
 whole AS (SELECT run_id, url, min(depth) AS depth FROM walk GROUP BY run_id, url),
 ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.run_id ORDER BY depth, COALESCE(q.priority, 0.3) DESC, q.pos NULLS FIRST, sha256(w.url)) AS visit FROM whole w LEFT JOIN q ON w.run_id = q.run_id AND w.url = q.url) """).removeprefix("WITH ")).replace("WITH ", "WITH RECURSIVE ", 1)


def _discovery(t: Tables, mode: str, **settings) -> DataFrame:
    pages = E.extract_pages(t.stored_pages).select("page_id", "url", "host", "internal_links")
    return links.select_urls(mode, _queue(t), pages, 3, exclude=["spam"], **settings)


@query("full_run_urls", "L4 L3", DISCOVERED + "SELECT run_id, url, depth FROM whole")
def full_run_urls(t: Tables):
    return _discovery(t, "full")


@query("sample_run_urls", "L4 E6", DISCOVERED + "SELECT run_id, url, depth FROM ranked WHERE visit <= 60")
def sample_run_urls(t: Tables):
    # More than a run's sitemap has, so that found links are among them.
    return _discovery(t, "sample", sample_size=60)


@query("sitemap_run_urls", "L4", QUEUE + "SELECT run_id, url, 0 AS depth FROM q")
def sitemap_run_urls(t: Tables):
    return links.select_urls("sitemap_only", _queue(t))


@query("manual_run_urls", "L4", WITH_URLS + "SELECT DISTINCT page_id % 5 AS run_id, crawl AS url, 0 AS depth FROM f")
def manual_run_urls(t: Tables):
    given = t.raw("pages").select((C("page_id") % 5).alias("run_id"), U.normalize_crawl(C("url")).alias("url")).distinct()
    return links.select_urls("manual", given)


FRONTIER = _link_sql(""", t AS (SELECT DISTINCT regexp_replace(regexp_replace(target, '#.*$', ''), '([^/])/$', '\\1') AS url FROM edges WHERE own),
 b AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '([^/])/$', '\\1') AS url FROM pages)""")


@query("crawl_frontier", "L3 L4 C9", FRONTIER + "SELECT url AS node, 0 AS depth FROM b UNION ALL SELECT url, 1 FROM t WHERE url NOT IN (SELECT url FROM b)")
def crawl_frontier(t: Tables):
    got = E.extract_pages(t.stored_pages).select("page_id", "url", "host", "internal_links")
    queue = t.raw("pages").select(U.normalize_crawl(C("url")).alias("url"))
    return links.crawl_frontier(got, queue, depth_limit=3)


@query("new_links", "C9 G4", FRONTIER + "SELECT sha256(url) AS url_hash FROM t WHERE url NOT IN (SELECT url FROM b)")
def new_links(t: Tables):
    edges = links.page_links(E.extract_pages(t.stored_pages))
    found = edges.select(U.url_hash(U.normalize_crawl(C("target"))).alias("url_hash")).distinct()
    return links.new_links(found, t.raw("pages").select(U.url_hash(U.normalize_crawl(C("url"))).alias("url_hash")))


@query("inbound_links", "L5", _link_sql("SELECT target, count(*) AS inbound FROM edges WHERE own GROUP BY target"))
def inbound_links(t: Tables):
    return links.inbound_counts(links.page_links(E.extract_pages(t.stored_pages)))


@query("orphan_pages", "L5", FRONTIER + "SELECT page_id FROM pages WHERE regexp_replace(regexp_replace(url, '#.*$', ''), '([^/])/$', '\\1') NOT IN (SELECT url FROM t)")
def orphan_pages(t: Tables):
    edges = links.page_links(E.extract_pages(t.stored_pages))
    return links.orphans(t.raw("pages").select("page_id", "url"), edges).select("page_id")


@query("hop_depths", "L3", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem),
 b(node, depth) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def hop_depths(t: Tables):
    one = t.raw("lineitem").select(C("l_partkey").alias("src"), C("l_suppkey").alias("dst"))
    two = t.raw("lineitem").select(C("l_suppkey").alias("src"), C("l_partkey").alias("dst"))
    root = t.raw("part").filter("p_partkey = 7").select(C("p_partkey").alias("node"))
    return links.hop_depths(one.unionByName(two), root, 3)


@query("final_canonicals", "L7", """WITH RECURSIVE c AS (SELECT o_orderkey AS node, o_custkey AS target FROM orders WHERE o_orderkey <> o_custkey),
 starts AS (SELECT o_orderkey AS node FROM orders UNION SELECT o_custkey FROM orders), w(start, node, step) AS (SELECT node, node, 0 FROM starts UNION ALL SELECT start, target, step + 1 FROM w JOIN c ON c.node = w.node WHERE step < 400),
 last AS (SELECT start, max(step) AS steps, arg_max(node, step) AS ended, min(node) FILTER (step >= 200) AS low FROM w GROUP BY start)
 SELECT start AS node, CASE WHEN steps = 400 THEN low ELSE ended END AS final, steps = 400 AS cyclic FROM last""")
def final_canonicals(t: Tables):
    chain = t.raw("orders").select(C("o_orderkey").alias("node"), C("o_custkey").alias("target"))
    return links.final_canonical(chain)


# --- patterns --------------------------------------------------------------------------------------
_PATTERNS = """p AS (SELECT p_partkey AS pattern_id, '/' || ['building', 'automobile', 'machinery', 'furniture', 'household'][p_partkey % 5 + 1] || '/[0-9]*' || (100 + p_partkey * 31 % 900) || '$' AS pattern,
 'type' || p_partkey % 13 AS page_type, p_partkey * 7919 % 1009 AS priority FROM part UNION ALL SELECT -1, '^https://site1[0-9][.]', 'tens', 5000 UNION ALL SELECT -2, '[05]$', 'fives', 6000)"""


@query("page_type_by_patterns", "C14", ctes("site_pages") + f""", {_PATTERNS}, m AS (SELECT url, page_type, pattern_id, row_number() OVER (PARTITION BY url ORDER BY priority, pattern_id) AS n FROM (SELECT DISTINCT url FROM site_pages) JOIN (SELECT pattern_id, pattern, page_type, priority FROM p) ON regexp_matches(url, pattern))
 SELECT u.url, COALESCE(m.page_type, 'unknown') AS page_type, m.pattern_id FROM (SELECT DISTINCT url FROM site_pages) u LEFT JOIN m ON m.url = u.url AND n = 1""")
def page_type_by_patterns(t: Tables):
    kinds = F.array(*[F.lit(k) for k in ("building", "automobile", "machinery", "furniture", "household")])
    k = C("p_partkey")
    made = t.raw("part").select(
        k.alias("pattern_id"), F.concat(F.lit("/"), F.get(kinds, (k % 5).cast("int")), F.lit("/[0-9]*"), (100 + k * 31 % 900).cast("string"), F.lit("$")).alias("pattern"),
        F.concat(F.lit("type"), (k % 13).cast("string")).alias("page_type"), (k * 7919 % 1009).alias("priority"),
    )
    fixed = t.spark.createDataFrame([(-1, "^https://site1[0-9][.]", "tens", 5000), (-2, "[05]$", "fives", 6000)], "pattern_id long, pattern string, page_type string, priority long")
    return patterns.first_matches(t.pages, made.unionByName(fixed))


# --- vectors ---------------------------------------------------------------------------------------
@query("related_to_topic", "L1 C15", """WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY 1, 2),
 c AS (SELECT label, list(v ORDER BY pos) AS centroid FROM m GROUP BY 1), s AS (SELECT c.label AS query_id, vec_id, list_cosine_similarity(centroid, CAST(embedding AS DOUBLE[])) AS sim FROM c CROSS JOIN embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def related_to_topic(t: Tables):
    base = t.raw("embeddings")
    topics = vectors.centroids(base, "label").select(C("label").cast("long").alias("query_id"), C("centroid").alias("vector"))
    return vectors.top_related(base, topics, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_NEAREST = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, e.vec_id, list_cosine_similarity(v, CAST(e.embedding AS DOUBLE[])) AS sim FROM q CROSS JOIN embeddings e WHERE e.vec_id <> query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)"""

#: Nearest neighbours asked for, and the share of them that the cells shall find.
NEAREST, RECALL = 10, 0.95


def _asked(base):
    return base.filter("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vector"))


def _others(found):
    """A query is a stored vector itself: it is left out of its own result, and what stood behind it moves up."""
    kept = found.filter("vec_id <> query_id")
    own = found.filter("vec_id = query_id").select("query_id", C("rank").alias("own"))
    moved = kept.join(own, "query_id", "left").withColumn("rank", F.when(C("rank") > C("own"), C("rank") - 1).otherwise(C("rank")))
    return moved.filter(C("rank") <= NEAREST).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("related_pages", "L1 C15", f"WITH {_NEAREST} SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def related_pages(t: Tables):
    base = t.raw("embeddings")
    return _others(vectors.top_related(base, _asked(base), NEAREST + 1))


@query("related_in_cells", "L1 C15", None)
def related_in_cells(t: Tables):
    base = t.raw("embeddings")
    index = cells.build(base)
    probes = cells.probes_for(index, base, _asked(base), NEAREST + 1, RECALL)
    return _others(cells.search(index, _asked(base), NEAREST + 1, probes))


@query("cell_recall", "L1 C15", f"WITH {_NEAREST} SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS reached FROM r WHERE rank <= 10")
def cell_recall(t: Tables):
    measured = cells.recall_of(related_in_cells(t), related_pages(t))
    return measured.select("queries", "wanted", (C("recall") >= 0.9).alias("reached"))


@query("topic_clusters", "L2", None)
def topic_clusters(t: Tables):
    return vectors.topic_clusters(t.raw("embeddings"), 8)

"""Crawl planning and the link graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..session import ensure_checkpoint_dir
from .ordered import first_seen, ranked, top_per_key

# --- fixed values: queue priority by origin --------------------------------------------
BASE_PRIORITY, SITEMAP_PRIORITY, LINK_PRIORITY = 1.0, 0.5, 0.3
RUN_TYPES = ("full", "sitemap_only", "sample", "delta", "manual")
# -----------------------------------------------------------------------------------------

#: Partitions that the edges of one node are dealt to.
HUB_PARTS = 8


def page_links(extracted: DataFrame, kind: str = "internal_links") -> DataFrame:
    """Link edges: page_id, source url, host, target url, anchor."""
    return extracted.select("page_id", "url", "host", F.explode(kind).alias("l")).select(
        "page_id", "url", "host", F.col("l.url").alias("target"), F.col("l.anchor").alias("anchor")
    )


def dedupe_urls(urls: DataFrame, url: str = "url", order: Sequence[str] = ("pos",), keep: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """First URL per crawl-form hash; carries ``keep`` of that first row."""
    shaped = urls.withColumn("normalized", U.normalize_crawl(F.col(url))).withColumn("url_hash", U.url_hash(F.col("normalized")))
    return first_seen(shaped, [*keys, "url_hash"], list(order), ["normalized", *keep])


def discovery_queue(sitemap_entries: DataFrame, bases: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Depth-0 queue per run: sitemap URLs plus the base URL where missing, each once.

    ``sitemap_entries``: run_id, url, pos, priority. ``bases``: run_id, url.
    """
    kept = sitemap_entries.filter(U.passes_patterns(F.col("url"), exclude=exclude)).select(
        "run_id", "url", (F.col("pos") + 1).alias("pos"), F.coalesce(F.when(F.col("priority") != 0, F.col("priority")), F.lit(SITEMAP_PRIORITY)).alias("priority"),
        F.lit(1).alias("origin"),
    )
    start = bases.select("run_id", "url", F.lit(0).cast("long").alias("pos"), F.lit(BASE_PRIORITY).alias("priority"), F.lit(2).alias("origin"))
    rows = kept.withColumn("pos", F.col("pos").cast("long")).unionByName(start)
    # A base that a sitemap lists keeps the sitemap's entry, hence origin before pos.
    return dedupe_urls(rows, order=("origin", "pos"), keep=("pos", "priority"), keys=("run_id",)).select(
        "run_id", "url_hash", F.col("normalized").alias("url"), "pos", "priority", F.lit(0).alias("depth")
    )


def in_visit_order(queue: DataFrame, width: int = 10_000) -> DataFrame:
    """Add ``visit`` (from 1): depth, then priority descending, then arrival. Hot runs are cut by depth,
    priority and ranges of arrival, which all follow the order."""
    bucket = F.struct("depth", (-F.col("priority")).alias("p"), F.floor(F.col("pos") / width).alias("block"))
    return ranked(queue, ["run_id"], bucket, visit_columns(), "visit")


def visit_columns() -> list[Column]:
    return [F.col("depth"), F.col("priority").desc(), F.col("pos"), F.col("url_hash")]


def sample(queue: DataFrame, size: int | None, order: Sequence[Column] | None = None, spread: str = "url_hash", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """First ``size`` of every run in visit order, with ``visit`` (from 1); None or 0 keeps the run whole.

    Only ``size`` rows of each split of a run are sorted together, the run itself never is.
    """
    if not size:
        return in_visit_order(queue)
    return top_per_key(queue, list(keys), order or visit_columns(), size, F.col(spread)).withColumnRenamed("rank", "visit")


def new_links(links: DataFrame, seen: DataFrame, key: str = "url_hash") -> DataFrame:
    return links.join(seen.select(key).distinct(), key, "left_anti")


def hop_depths(edges: DataFrame, roots: DataFrame, depth_limit: int, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes reached from ``roots`` within ``depth_limit`` hops, with their least depth.

    ``edges``: src, dst, and the keys if each key has edges of its own. ``roots``: keys, node. Edges and seen nodes are dealt into hash
    partitions once and stay there, so a round moves the frontier only: to its edges, and what it finds to the seen nodes. The edges of a hub lie in
    ``HUB_PARTS`` partitions, to each of which its one frontier row goes. Rounds are checkpointed to the shared folder, with their partitioning, so a
    lost executor costs one round at most and lineage stays short.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    keys = list(keys)
    shared = [k for k in keys if k in edges.columns]
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.hash("dst"), F.lit(HUB_PARTS)).alias("part")
    links = edges.select(*shared, "src", "dst").distinct().select("*", part).repartition(parts, *shared, "src", "part").sortWithinPartitions(*shared, "src", "part").transform(placed)
    seen = roots.select(*keys, "node").distinct().withColumn("depth", F.lit(0)).repartition(parts, *keys, "node").transform(placed)
    frontier = seen
    for depth in range(1, depth_limit + 1):
        found = next_nodes(frontier, links, seen, keys, shared)
        step = found.withColumn("depth", F.lit(depth)).transform(placed)
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
        if depth % 4 == 0:
            seen = seen.transform(placed)
        frontier = step
    return seen


def placed(frame: DataFrame) -> DataFrame:
    """A checkpoint whose partitioning is known to later plans. An adaptive plan doesn't tell its own, so it is off for this one."""
    conf = frame.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return frame.checkpoint()
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def next_nodes(frontier: DataFrame, links: DataFrame, seen: DataFrame, keys: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Nodes behind the frontier that were not seen. ``links`` and ``seen`` are partitioned by the columns they are joined on."""
    ahead = frontier.select(*keys, F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).alias("part"))
    return ahead.join(links, [*shared, "src", "part"]).select(*keys, F.col("dst").alias("node")).distinct().join(seen, [*keys, "node"], "left_anti")


def crawl_frontier(extracted: DataFrame, queue: DataFrame, depth_limit: int, exclude: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """URLs a full run visits: the queue plus internal links up to ``depth_limit`` hops away, per run if ``keys`` names the run.

    ``extracted``: stored pages (url, host, internal_links; no run, as a page's links are the same in each). Links must stay on the page's
    host and pass the exclusions; URLs are compared in crawl form.
    """
    edges = (
        page_links(extracted)
        .filter((U.host_of(F.col("target")) == F.col("host")) & U.passes_patterns(F.col("target"), exclude=exclude))
        .select(U.normalize_crawl(F.col("url")).alias("src"), U.normalize_crawl(F.col("target")).alias("dst"))
    )
    return hop_depths(edges, queue.select(*keys, F.col("url").alias("node")), depth_limit, keys)


def discovered(extracted: DataFrame, queue: DataFrame, depth_limit: int, exclude: Sequence[str] = ()) -> DataFrame:
    """Full discovery per run: the queue with its priorities, and found links with the priority of links behind them.

    Links have no order of arrival that survives distribution; of equal depth and priority they stand in the order of their hash.
    """
    found = crawl_frontier(extracted, queue, depth_limit, exclude, ["run_id"]).filter("depth > 0")
    links = found.select("run_id", U.url_hash(F.col("node")).alias("url_hash"), F.col("node").alias("url"), F.lit(None).cast("long").alias("pos"), F.lit(LINK_PRIORITY).alias("priority"), "depth")
    return queue.select("run_id", "url_hash", "url", "pos", "priority", "depth").unionByName(links)


def select_urls(run_type: str, queue: DataFrame, extracted: DataFrame | None = None, depth_limit: int = 3,
                sample_size: int | None = None, changed: DataFrame | None = None, strict: bool = False, bases: DataFrame | None = None,
                exclude: Sequence[str] = ()) -> DataFrame:
    """(run_id, url, depth) that each run of the queue visits, by run type.

    full: queue and links; sitemap_only: queue; sample: the first ``sample_size`` of full discovery in visit order
    (``strict``: of the base URLs only, ``bases``: run_id, url); delta: queue entries whose content changed (``changed``:
    url); manual: the given queue at depth 0.
    """
    if run_type not in RUN_TYPES:
        raise ValueError(f"run_type must be one of {RUN_TYPES}")
    flat = queue.select("run_id", "url", F.lit(0).alias("depth"))
    if run_type in ("sitemap_only", "manual"):
        return flat
    if run_type == "delta":
        return flat.join(changed.select("url").distinct(), "url", "left_semi").select("run_id", "url", "depth")
    if run_type == "sample" and strict:
        own = bases.select("run_id", U.normalize_crawl(F.col("url")).alias("url")).distinct()
        return sample(queue.join(own, ["run_id", "url"], "left_semi"), sample_size).select("run_id", "url", "depth")
    full = discovered(extracted, queue, depth_limit, exclude)
    return (full if run_type == "full" else sample(full, sample_size)).select("run_id", "url", "depth")


def inbound_counts(edges: DataFrame, target: str = "target") -> DataFrame:
    return edges.groupBy(target).agg(F.count("*").alias("inbound"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages (url) no other page links to; both sides compared in crawl form."""
    linked = edges.select(U.normalize_crawl(F.col("target")).alias("norm"))
    return pages.withColumn("norm", U.normalize_crawl(F.col("url"))).join(linked, "norm", "left_anti").drop("norm")


def final_canonical(chain: DataFrame) -> DataFrame:
    """Follow canonical chains (``node`` -> ``target``, one per node) to their end, by pointer doubling.

    A chain that runs into a cycle, from a tail of any length, ends at the cycle's smallest node. Every round doubles the hops. The nodes
    that are still jumped to only become fewer, and once a round leaves their number unchanged they are exactly the ends and
    the nodes of cycles. It is the last one if, besides, the smallest node seen changed for none of them: then it is the same along
    each cycle, all of which has been seen. A popular target is the skewed side of a join whose other side has one row per node.
    """
    ensure_checkpoint_dir(chain.sparkSession)
    # A page that names itself is an end, not a cycle.
    step = chain.filter("node != target").select("node", F.col("target").alias("jump"), F.least("node", "target").alias("low"), F.lit(True).alias("open"))
    nodes = chain.select("node").unionByName(chain.select(F.col("target").alias("node"))).distinct()
    ends = nodes.join(step.select("node"), "node", "left_anti")
    ends = ends.select("node", F.col("node").alias("jump"), F.col("node").alias("low"), F.lit(False).alias("open"))
    state, known = step.unionByName(ends).checkpoint(), None
    while True:
        nxt = state.select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("low").alias("l2"), F.col("open").alias("o2"))
        state = state.join(nxt, "jump").select(
            "node", F.col("j2").alias("jump"), F.least("low", "l2").alias("low"), (F.col("open") & F.col("o2")).alias("open"), (F.col("l2") < F.col("low")).alias("moved")
        ).checkpoint()
        jumped = state.select(F.col("jump").alias("node")).distinct()
        count = jumped.count()
        if count == known and state.filter("open and moved").join(jumped, "node", "left_semi").isEmpty():
            break
        known = count
    # What is still open circles, and its jump lies on the cycle.
    circle = state.select(F.col("node").alias("jump"), F.col("low").alias("cycle_low"))
    return state.join(circle, "jump").select(
        "node", F.when(F.col("open"), F.col("cycle_low")).otherwise(F.col("jump")).alias("final"), F.col("open").alias("cyclic")
    )


def canonical_classes(pages: DataFrame) -> DataFrame:
    """Each page (page_id, url, html) with the ``canonical_url`` of its class, and whether the class circles.

    Pages whose URLs have the same form are one node, and a declared canonical link leads from node to node; a class is what ends at
    the same node, or in the same cycle, whose smallest form then stands for it. Where pages of one form declare several
    canonicals, the smallest that is another form holds. The iteration runs over forms only, without the markup.
    """
    form = U.normalize_crawl(F.col("url"), U.DEFAULT_IGNORE_PARAMS).alias("node")
    linked = pages.select("page_id", "url", form, U.resolve_canonical_crawl(F.col("url"), F.col("html")).alias("target"))
    chain = linked.groupBy("node").agg(F.min(F.when(F.col("target") != F.col("node"), F.col("target"))).alias("target"))
    final = final_canonical(chain.select("node", F.coalesce("target", "node").alias("target")))
    return pages.select("page_id", "url", form).join(final, "node").select("page_id", "url", F.col("final").alias("canonical_url"), "cyclic")


def pending(discovered: DataFrame, processed: DataFrame, on: Sequence[str] = ("run_id", "url_hash")) -> DataFrame:
    """What a resumed run still has to do."""
    return discovered.join(processed, list(on), "left_anti")

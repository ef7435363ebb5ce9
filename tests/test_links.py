"""Rounds of the link frontier and classes of canonical links."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from siteglass.operators import links


def breadth_first(edges, roots, limit):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    depth = {r: 0 for r in roots}
    front = set(roots)
    for d in range(1, limit + 1):
        front = {b for a in front for b in out[a]} - depth.keys()
        depth.update({b: d for b in front})
    return depth


def test_depths_with_a_hub(spark):
    """A node with half of all edges, cycles, self links, repeated edges and nulls."""
    r = random.Random(5)
    edges = [(0, i) for i in range(1, 400)] + [(r.randrange(400), r.randrange(900)) for _ in range(400)] + [(3, 3), (0, 1), (3, 0)]
    frame = spark.createDataFrame([*edges, (None, 5), (5, None)], "src long, dst long")
    for limit in (0, 1, 2, 9):
        got = {x.node: x.depth for x in links.hop_depths(frame, spark.createDataFrame([(17,), (0,), (0,)], "node long"), limit).collect() if x.node is not None}
        assert got == breadth_first(edges, [17, 0], limit)
    assert links.hop_depths(frame.limit(0), spark.createDataFrame([(1,)], "node long"), 3).collect()[0].asDict() == {"node": 1, "depth": 0}


def test_depths_per_run(spark):
    edges, roots = [(1, 2), (2, 3), (3, 4), (7, 2)], [(1, 1), (2, 7), (2, 3), (3, 9)]
    got = {(x.run, x.node): x.depth for x in links.hop_depths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(roots, "run long, node long"), 5, ["run"]).collect()}
    assert got == {(run, n): d for run in (1, 2, 3) for n, d in breadth_first(edges, [b for a, b in roots if a == run], 5).items()}


def test_a_round_moves_the_frontier_only(spark, monkeypatch):
    """In the plan of a late round every exchange is on the frontier's side: the stored edges and seen nodes are read as they lie."""
    rounds, real = [], links.next_nodes

    def watched(*args):
        rounds.append(real(*args))
        return rounds[-1]

    monkeypatch.setattr(links, "next_nodes", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links.hop_depths(spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long"), spark.createDataFrame([(0,)], "node long"), 3)
        plan = rounds[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanged = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    assert len(rounds) == 3 and len(exchanged) == 2, plan
    assert "src" in exchanged[1] and "node" in exchanged[0], plan


def test_canonical_classes(spark):
    """A chain, a pair that names each other, forms of one URL, a page without a link, and an empty table."""
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    site = "https://a.example.com/"
    rows = [
        (1, site + "one", link(site + "two")), (2, site + "two/", link(site + "three")), (3, site + "three", "<html></html>"), (4, site + "three/?utm_source=x", ""),
        (5, site + "x", link(site + "y")), (6, site + "y", link(site + "x")), (7, site + "alone", link(site + "alone")), (8, site + "far", link("https://b.example.com/none")),
        (9, site + "tail", link(site + "y")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: (x.canonical_url, x.cyclic) for x in links.canonical_classes(pages).collect()}
    assert got == {
        **{i: (site + "three", False) for i in (1, 2, 3, 4)}, 5: (site + "x", True), 6: (site + "x", True), 9: (site + "x", True),
        7: (site + "alone", False), 8: ("https://b.example.com/none", False),
    }
    assert links.canonical_classes(pages.limit(0)).collect() == []

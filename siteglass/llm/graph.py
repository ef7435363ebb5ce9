"""Connected components of a link table, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Alternates large-star and small-star rounds: each node's links are hung on the smallest neighbour. Links only move
    towards smaller nodes, and at the end every node hangs on its root. Minima are combined before the shuffle and only
    links move, so no component comes together in a task. Lineage is cut each round in the shared checkpoint folder.
    Null ends and self links are ignored; no links give an empty table.
    """
    ensure_checkpoint_dir(links.sparkSession)
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: a node's larger neighbours hang on its smallest neighbour (or on itself).
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        pairs = small.checkpoint()
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

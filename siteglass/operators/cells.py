"""Approximate nearest vectors by an inverted file: vectors in cells around centres, of which a query probes the nearest few.

The centres are fitted on a bounded sample, every vector is indexed. A cell is cut into blocks of bounded size, so a task holds one block of
vectors and one of queries whatever the size of the table or of its largest cell. Candidates are ranked by their exact cosine.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .ordered import top_per_key
from .vectors import best_of_blocks, top_related, unit, usable

#: Vectors that the centres are fitted on, at most about so many: picked by the hash of their id.
FIT_ROWS = 100_000
#: Cells at most: the centres (cells x dimensions) are held in each task.
MOST_CELLS = 4096
#: Vectors and queries that meet in one task at most, about.
BLOCK_ROWS, QUERY_ROWS = 50_000, 5_000
#: Queries that the number of probes is measured on.
TUNING_QUERIES = 200


@dataclass(frozen=True)
class CellIndex:
    """``centres``: unit vectors, a row per cell. ``table``: path of (cell, block, vec_id, vector), each vector once. ``blocks``: blocks per cell."""

    centres: np.ndarray
    table: str
    blocks: tuple[int, ...]

    def vectors(self, frame: DataFrame) -> DataFrame:
        return frame.sparkSession.read.parquet(self.table)


def _nearest(centres: np.ndarray, probes: int):
    """Arrow step: (id, vector) to (id, vector, cells), the ``probes`` nearest cells, nearest first, ties by number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(near.reshape(-1)))], names=["id", "vector", "cells"])

    return run


def with_cells(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cells) of unit vectors (id, vector)."""
    return vectors.select("id", "vector").mapInArrow(_nearest(centres, probes), "id long, vector array<double>, cells array<int>")


def _units(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    return usable(vectors, id_, vector).select(F.col(id_).alias("id"), unit(F.col("vector")).alias("vector"))


def fit_centres(units: DataFrame, rows: int, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of KMeans on about ``FIT_ROWS`` of ``rows`` unit vectors. Lengths must be equal."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, FIT_ROWS / max(rows, 1))
    sample = units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).select(array_to_vector("vector").alias("features"))
    if cells < 2:
        return np.array(sample.limit(1).collect()[0]["features"].toArray())[None]
    model = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2, featuresCol="features", predictionCol="cell").fit(sample)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def build(vectors: DataFrame, cells: int | None = None, id_: str = "vec_id", vector: str = "embedding") -> CellIndex | None:
    """Index of every usable vector, written to the shared folder; none where there is no vector.

    ``cells``: the root of the number of vectors unless given, at most ``MOST_CELLS``. Vectors must have one length; null and zero vectors, and
    those with a null entry, have no similarity and are left out.
    """
    spark = vectors.sparkSession
    units = _units(vectors, id_, vector)
    found = units.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if not found["n"]:
        return None
    if found["least"] != found["most"]:
        raise ValueError(f"vectors of {found['least']} to {found['most']} dimensions")
    centres = fit_centres(units, found["n"], min(MOST_CELLS, cells or max(1, math.isqrt(found["n"]))))
    base = f"{shared_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    placed = with_cells(units, centres, 1).select(F.col("cells")[0].alias("cell"), F.col("id").alias("vec_id"), "vector")
    placed.write.parquet(f"{base}/placed")
    placed = spark.read.schema("cell int, vec_id long, vector array<double>").parquet(f"{base}/placed")
    # At most MOST_CELLS counts; the hot cells get more blocks.
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = tuple(max(1, -(-sizes.get(c, 0) // BLOCK_ROWS)) for c in range(len(centres)))
    number = F.get(F.array(*[F.lit(b) for b in blocks]), F.col("cell"))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), number).cast("int"))
    dealt.repartition("cell", "block").sortWithinPartitions("cell", "block").write.parquet(f"{base}/index")
    return CellIndex(centres, f"{base}/index", blocks)


def search(index: CellIndex, queries: DataFrame, k: int, probes: int, id_: str = "query_id", vector: str = "vector") -> DataFrame:
    """query_id, vec_id, similarity, rank: the ``k`` best of the vectors in the ``probes`` nearest cells, ties by id.

    With as many probes as cells the result is exact. Queries without a direction have no rows. A query is sent to each block of its cells
    (equi-join on cell and block); many queries of one cell are dealt into groups that meet the block in tasks of their own.
    """
    asked = with_cells(_units(queries, id_, vector), index.centres, probes)
    number = F.array(*[F.lit(b) for b in index.blocks])
    sent = asked.select(F.col("id").alias("query_id"), "vector", F.explode("cells").alias("cell"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(number, F.col("cell")) - 1)))
    crowd = sent.groupBy("cell").agg(F.count_distinct("query_id").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, -(-crowd // QUERY_ROWS))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    stored = index.vectors(queries).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["cell", "block", "part"]
    met = stored.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(best_of_blocks(k), "query_id long, vec_id long, similarity double")
    return top_per_key(met, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")], k, F.col("vec_id"))


def probes_for(index: CellIndex, vectors: DataFrame, queries: DataFrame, k: int, recall: float, id_: str = "vec_id", vector: str = "embedding") -> int:
    """Least number of probes that finds ``recall`` of the true ``k`` nearest, measured on about ``TUNING_QUERIES`` of the queries (query_id, vector).

    The exact neighbours of the sample are found among all vectors; a neighbour counts for p probes if its cell is among the query's p nearest.
    """
    total = queries.count()
    share = min(1.0, TUNING_QUERIES / max(total, 1))
    sample = queries.where(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20))))
    true = top_related(vectors.select(F.col(id_).alias("vec_id"), F.col(vector).alias("embedding")), sample, k).select("query_id", "vec_id")
    order = with_cells(_units(sample, "query_id", "vector"), index.centres, len(index.centres)).select(F.col("id").alias("query_id"), F.posexplode("cells").alias("at", "cell"))
    where = index.vectors(vectors).select("vec_id", "cell").join(true, "vec_id").join(order, ["query_id", "cell"])
    counts = where.groupBy("at").agg(F.count("*").alias("n")).collect()  # a row per cell at most
    found, wanted = 0, recall * sum(r["n"] for r in counts)
    for row in sorted(counts, key=lambda r: r["at"]):
        found += row["n"]
        if found >= wanted:
            return row["at"] + 1
    return len(index.centres)


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries, wanted (true neighbours), hits, recall of ``found`` against the exact result ``true`` (both query_id, vec_id)."""
    hits = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))

"""Related pages by cosine similarity, and topic clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import top_per_key

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group: exploded sums, so a hot group combines before the shuffle."""
    parts = vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one entry per dimension
    return parts.groupBy(by).agg(F.transform(ordered, lambda p: p["x"]).alias("centroid"))


def usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, vector as doubles) of the rows that have a direction: not null, empty or zero, and without null entries."""
    cast = df.select(id_, F.col(vector).cast("array<double>").alias("vector")).where(F.size("vector") > 0)
    return cast.where(~F.exists("vector", lambda x: x.isNull()) & (dot(F.col("vector"), F.col("vector")) > 0))


def best_of_blocks(k: int):
    """Over a block of stored vectors and one of queries: the k best of each query, ties by id."""

    def unit_rows(table: pa.Table) -> np.ndarray:
        rows = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if stored.num_rows and asked.num_rows:
            stored = stored.sort_by("vec_id")
            ids, rows = stored.column("vec_id").to_numpy(), unit_rows(stored)
            for name, query in zip(asked.column("query_id").to_numpy(), unit_rows(asked)):
                scores = rows @ query
                near = np.argsort(-scores, kind="stable")[:k]
                out.append((np.full(len(near), name), ids[near], scores[near]))
        return pa.table({c: np.concatenate(values) for c, values in zip(("query_id", "vec_id", "similarity"), zip(*out))})

    return run


#: Stored vectors and queries that meet in one task, about.
BLOCK_ROWS, QUERY_ROWS = 50_000, 2_000


def top_related(
    vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", query_vector: str = "vector", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """Exact k most similar stored vectors for each query vector, ties by id.

    Stored vectors and queries are counted and dealt by hash into blocks of about ``block_rows`` and ``query_rows``; every pair of blocks meets in
    one task, so tasks grow in number and not in size. A task sends on k rows per query, never all pairs, and the k best of those are kept. Nothing
    goes through the driver. Null and zero vectors have no similarity and are left out on either side; a query meets vectors of its own
    length. No queries, no rows.
    """
    stored, asked = usable(vectors, "vec_id", vector), usable(queries, "query_id", query_vector)
    ps, qs = max(1, -(-vectors.count() // block_rows)), max(1, -(-queries.count() // query_rows))
    stored = stored.withColumns({"p": F.pmod(F.xxhash64("vec_id"), F.lit(ps)), "q": F.explode(F.sequence(F.lit(0), F.lit(qs - 1)))})
    asked = asked.withColumns({"q": F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int"), "p": F.explode(F.sequence(F.lit(0), F.lit(ps - 1)))})
    of = lambda df: df.withColumn("p", F.col("p").cast("int")).withColumn("size", F.size("vector")).groupBy("p", "q", "size")
    found = of(stored).cogroup(of(asked)).applyInArrow(best_of_blocks(k), "query_id long, vec_id long, similarity double")
    return top_per_key(found, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")], k, F.col("vec_id"))


def unit(vector: Column) -> Column:
    """The vector over its length; the length is bound once, not computed for each entry."""
    over = lambda length: F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
    return F.transform(F.array(F.sqrt(dot(vector, vector))), over)[0]


def fit_topics(vectors: DataFrame, k: int, vector: str = "embedding", seed: int = 7):
    """KMeans on unit vectors (Spark ML). Returns the model and the frame with ``features``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    shaped = vectors.withColumn("features", array_to_vector(unit(F.col(vector))))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic", maxIter=20).fit(shaped), shaped


def topic_clusters(vectors: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """vec_id, topic."""
    model, shaped = fit_topics(vectors, k, vector)
    return model.transform(shaped).select("vec_id", "topic")

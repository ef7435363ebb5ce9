"""Stored tables whose changes rewrite only the buckets they touch.

A table is a folder of Parquet files in hash buckets of its key, one partition ``bucket=N`` each. A change reads the buckets of its keys, writes their new
rows beside the table, and then swaps them in by a dynamic partition overwrite; all other files stay as they are. Until the swap
a failed change has changed nothing, and each row notes the number of the last batch that it took in, so a replayed batch is without effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir
from .tables import ENDED

#: Number of the last batch that a row took in; null before the first.
BATCH = "_batch"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int
    schema: str  # of the rows, with ``_batch`` and ``bucket``

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)

    def read(self) -> DataFrame:
        """The rows as they are now, without the store's own columns."""
        return self._all().drop(BATCH, "bucket")

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of the keys of ``changes``: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the touched buckets by ``merge(rows, changes)``; returns their numbers.

        ``merge`` gets the rows of these buckets with ``_batch``, and keeps both key and ``_batch``.
        """
        numbers = self.touched(changes)
        if not numbers:
            return []
        rows = self._all().where(F.col("bucket").isin(numbers)).drop("bucket")
        staged = f"{self.path}-{uuid.uuid4().hex}"
        merged = merge(rows, changes).withColumn("bucket", self._bucket())
        _dealt(merged).write.partitionBy("bucket").parquet(staged)
        new = self.spark.read.schema(self.schema).option("basePath", staged).parquet(staged)
        left = {r[0] for r in new.select("bucket").distinct().collect()}
        _write(new, self.path)
        # Where every row of a bucket went, there is no partition to put in its place.
        _remove(self.spark, [f"{self.path}/bucket={n}" for n in numbers if n not in left])
        _remove(self.spark, [staged])
        return numbers


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a bucket together, but a large bucket in several tasks: adaptive execution splits and joins partitions by their size."""
    return rows.hint("rebalance", F.col("bucket"))


def _write(rows: DataFrame, path: str) -> None:
    """Few files a bucket, in place of the bucket's files."""
    _dealt(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def create(rows: DataFrame, key: Sequence[str], buckets: int, path: str | None = None, name: str = "table") -> Store:
    """Write ``rows``, one per key, as a new store; in the shared folder unless ``path`` is given."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    full = rows.withColumn(BATCH, F.lit(None).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema) + ", bucket int"
    store = Store(spark, path, tuple(key), buckets, schema)
    _write(full.withColumn("bucket", store._bucket()), path)
    return store


def _on(key: Sequence[str]) -> Column:
    """Equal keys, null parts included."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return out


def _fresh(batch: int) -> Column:
    """The stored row hasn't taken this batch in yet."""
    return F.col(f"o.{BATCH}").isNull() | (F.col(f"o.{BATCH}") < batch)


def upsert_pages(store: Store, batch: DataFrame, number: int, now: Column, given: Sequence[str]) -> list[int]:
    """Insert or update pages: ``batch`` has the key, url, ``pos`` (its order) and the fields ``given``; within a key the last non-null value wins.

    An inserted page gets ``first_discovered_at``, and ``last_crawled_at`` if the batch names its run; an updated one keeps the first and gets the second.
    """
    newest = batch.groupBy(*store.key).agg(
        F.min_by("url", "pos").alias("url"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in given], F.lit(True).alias("_new")
    )

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        both = rows.withColumn("_old", F.lit(True)).alias("o").join(changes.alias("n"), _on(store.key), "full_outer")
        old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull() & (F.col("_old").isNull() | _fresh(number))
        crawled = F.col("n.last_crawl_run_id").isNotNull() if "last_crawl_run_id" in given else F.lit(False)
        out = {k: F.coalesce(f"o.{k}", f"n.{k}") for k in store.key}
        out |= {c: F.when(new, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")) for c in given}
        out |= {
            "url": F.coalesce("o.url", "n.url"), "first_discovered_at": F.when(old, F.col("o.first_discovered_at")).otherwise(now),
            "last_crawled_at": F.when(new & (old | crawled), now).otherwise(F.col("o.last_crawled_at")), BATCH: F.when(new, F.lit(number)).otherwise(F.col(f"o.{BATCH}")),
        }
        return both.select(*[out.get(c, F.col(f"o.{c}")).alias(c) for c in rows.columns])

    return store.change(newest, merge)


def update_runs(store: Store, updates: DataFrame, number: int, now: Column, columns: Sequence[str]) -> list[int]:
    """Overwrite ``columns`` by the non-null values of the row of ``updates`` with the run's key; a run that ends gets its completion time."""

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        both = rows.alias("o").join(changes.withColumn("_new", F.lit(True)).alias("n"), _on(store.key), "left")
        new = F.col("_new").isNotNull() & _fresh(number)
        out = {c: F.when(new, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")) for c in columns}
        ended = out.get("status", F.col("o.status")).isin(*ENDED) & F.col("o.completed_at").isNull()
        out |= {BATCH: F.when(new, F.lit(number)).otherwise(F.col(f"o.{BATCH}")), "completed_at": F.when(new & ended, now).otherwise(F.col("o.completed_at"))}
        return both.select(*[out.get(c, F.col(f"o.{c}")).alias(c) for c in rows.columns])

    return store.change(updates.select(*store.key, *columns), merge)


def add_counts(store: Store, deltas: DataFrame, number: int, counters: Sequence[str]) -> list[int]:
    """Add deltas to the counters of their rows: summed per key before they move; a replayed batch adds nothing. Unknown keys are ignored."""
    sums = deltas.groupBy(*store.key).agg(*[F.sum(c).alias(c) for c in counters])

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        both = rows.alias("o").join(changes.withColumn("_new", F.lit(True)).alias("n"), _on(store.key), "left")
        new = F.col("_new").isNotNull() & _fresh(number)
        kinds = dict(rows.dtypes)
        out = {c: F.when(new, F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))).otherwise(F.col(f"o.{c}")).cast(kinds[c]) for c in counters}
        out[BATCH] = F.when(new, F.lit(number)).otherwise(F.col(f"o.{BATCH}"))
        return both.select(*[out.get(c, F.col(f"o.{c}")).alias(c) for c in rows.columns])

    return store.change(sums, merge)


def delete_children(store: Store, gone: DataFrame) -> list[int]:
    """Delete the rows whose key is among those of ``gone``; the store is kept by the parent's key, so only the parents' buckets are rewritten."""

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return rows.alias("o").join(changes.alias("n"), _on(store.key), "left_anti")

    return store.change(gone.select(*store.key).distinct(), merge)

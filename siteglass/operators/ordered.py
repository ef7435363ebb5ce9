"""Ordered per-key operators that survive a key holding a third of all rows.

A plain window sorts one whole key in one task. Here each key is cut into buckets that follow
the order (a day of a time series, a range of positions): windows run inside buckets, and a
second window runs over one summary row per bucket. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE = (Window.unboundedPreceding, -1)


def _slotted(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Partitioned by ``_slot``, the key and bucket as one struct: structs compare null fields as equal, so no row is lost, and
    the windows, the summary per bucket and the join below all use this one exchange."""
    return df.withColumn("_slot", F.struct(*keys, bucket.alias("_bucket"))).repartition("_slot")


def _over_buckets(keys: Sequence[str]):
    return Window.partitionBy(*[F.col(f"_slot.{k}") for k in keys]).orderBy("_slot._bucket")


def running_before(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the key (0 for the first).

    ``bucket`` must not decrease along ``order``; ``order`` must be total within a key. Null keys form a key, null buckets come first.
    """
    rows = _slotted(df.withColumn("_value", value), keys, bucket)
    sums = rows.groupBy("_slot").agg(F.sum("_value").alias("_sum"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(_over_buckets(keys).rowsBetween(*BEFORE)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_slot").orderBy(*order).rowsBetween(*BEFORE)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(offsets, "_slot")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_value", "_slot", "_offset", "_inside")
    )


def ranked(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based row number within the key."""
    counted = running_before(df, keys, bucket, order, F.lit(1), name)
    return counted.withColumn(name, F.col(name) + 1)


def with_previous(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add ``struct<value>`` of the previous row of the key as ``name`` (null for the first row)."""
    rows = _slotted(df, keys, bucket)
    ends = rows.groupBy("_slot").agg(F.max_by(F.struct(F.col(value).alias("value")), F.struct(*order)).alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(_over_buckets(keys))).drop("_last")
    inside = Window.partitionBy("_slot").orderBy(*order)
    return (
        rows.withColumn("_near", F.lag(F.struct(F.col(value).alias("value"))).over(inside))
        .join(carried, "_slot")
        .withColumn(name, F.coalesce("_near", "_carried"))
        .drop("_slot", "_near", "_carried")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: ``columns`` of the row with the greatest ``order``. Combines before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: ``columns`` of the row with the least ``order``."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Column, splits: int = 32) -> DataFrame:
    """First ``n`` rows per key. Every split of a key is cut to ``n`` rows before they meet."""
    part = Window.partitionBy(*keys, "_split").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_split", F.pmod(F.xxhash64(spread), F.lit(splits)))
        .withColumn("rank", F.row_number().over(part))
        .filter(F.col("rank") <= n)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= n)
        .drop("_split")
    )

"""Pages of a sorted list, however deep, without sorting or passing over what lies before them."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir

PART, RANK = "_part", "rank"


@dataclass(frozen=True)
class SortedList:
    """A table in range partitions of its order. ``starts``: rows before each partition, and behind the last all rows."""

    spark: SparkSession
    path: str
    schema: str
    order: tuple[Column, ...]
    starts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return self.starts[-1]

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of page ``number`` (from 1) with their ``rank`` in the list; reads only the partitions that the page lies in.

        A page behind the end is empty. Nothing passes through the driver.
        """
        if number < 1 or size < 1:
            raise ValueError("page number and size must be at least 1")
        first, last = (number - 1) * size, min(number * size, self.rows)
        table = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)
        if first >= self.rows:
            return table.where(F.lit(False)).withColumn(RANK, F.lit(0).cast("long")).drop(PART)
        parts = range(bisect_right(self.starts, first) - 1, bisect_right(self.starts, last - 1))
        before = F.create_map(*[F.lit(x) for p in parts for x in (p, self.starts[p])])
        inside = F.row_number().over(Window.partitionBy(PART).orderBy(*self.order))
        ranked = table.where(F.col(PART).isin(list(parts))).withColumn(RANK, F.element_at(before, F.col(PART)) + inside)
        return ranked.where((F.col(RANK) > first) & (F.col(RANK) <= last)).drop(PART)


def sorted_list(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> SortedList:
    """Write ``df`` in ranges of ``order``, once for all its pages. The order must be total, so that rows of one value can be split."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/sorted-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id())
    dealt.write.partitionBy(PART).parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    counts = {r[PART]: r["n"] for r in spark.read.schema(schema).option("basePath", path).parquet(path).groupBy(PART).agg(F.count("*").alias("n")).collect()}  # a row per partition
    return SortedList(spark, path, schema, tuple(order), tuple(accumulate([0, *[counts.get(p, 0) for p in range(n)]])))

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: White space of the contracts: blank and U+0009 to U+000D. ``bytes.split()`` splits at the same characters.
SPACES = " \t\n\x0b\f\r"

#: Bytes of text that a Python step handles at once; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Frees the shuffle files of a query when the query ends, instead of when the driver next collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []


def kept(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: a cut of the lineage that outlives any executor.

    Once the table is written nothing reads the shuffles behind it again, so their files go at once.
    """
    spark = frame.sparkSession
    path, before = scratch(spark, name), spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before else spark.conf.unset(FREE_SHUFFLES)
    _made.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def made_since(mark: int) -> list[str]:
    return _made[mark:]


def made_so_far() -> int:
    return len(_made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder, by the file system they are on."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole(frame: DataFrame) -> Column:
    """All columns of a table as one struct: carried so, their names can't clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns])


def fold(column: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def below(wanted: int, of: int) -> int:
    """The 64-bit hash up to which about ``wanted`` of ``of`` rows lie."""
    return -(1 << 63) + min((1 << 64) - 1, (wanted << 64) // max(1, of))


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of bounded text size; a null text becomes an empty one."""
    for batch in batches:
        texts = batch.column(column)
        start, held = 0, 0
        sizes = pa.compute.coalesce(pa.compute.binary_length(texts), 0).to_pylist()
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, held = i, 0
            held += size
        if start < len(sizes):
            part = batch.slice(start)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def made(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """A batch of the id column ``doc_id`` and new columns of the same length."""
    arrays = [batch.column("doc_id"), *[c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()]]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])

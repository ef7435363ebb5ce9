"""Event stream input and the sinks the jobs share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir, tune

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None, bytes_per_trigger: int = 512 * 1024 * 1024) -> DataFrame:
    """Event table as a stream. The admission limit (bytes, or a number of files) bounds what one
    micro-batch can hold of any key, however hot.

    Watermarks need an instant, so the zone-less ``ts`` becomes ``event_time`` (UTC).
    """
    tune(spark)
    limit = ("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", bytes_per_trigger)
    reader = spark.readStream.schema(EVENT_SCHEMA).option(*limit)
    # A glob serves a table stored as one file as well as one stored as a folder.
    return reader.parquet(f"{folder}/events.parque[t]").withColumn("event_time", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over all available input into a parquet table; return the table."""
    spark = stream.sparkSession
    base = _folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


@dataclass(frozen=True)
class Step:
    """One micro-batch of a fold over keyed state.

    ``run(batch, before)`` returns the output and the new state rows of the batch's keys: ``key``, the step's own columns and ``until``, the event time
    up to which the row is remembered. ``before`` has the rows of these keys' buckets, or is None where there are none yet.
    """

    key: str
    run: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


class BucketState:
    """State rows in hash buckets of their key; a micro-batch writes new versions of the buckets of its keys only.

    ``version=N/bucket=B`` is the bucket after micro-batch N. A bucket keeps two versions: the newest, and the one a replayed batch starts from.
    ``marks`` holds the newest event time after each batch; rows whose ``until`` lies before it are forgotten. Every ``sweep`` batches all
    buckets are rewritten, so keys that never come back leave the disk, too.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int, sweep: int):
        self.spark, self.base, self.buckets, self.sweep = spark, base, buckets, sweep

    def _list(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()] if files.exists(at) else []

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self, number: int) -> dict[int, list[int]]:
        """Versions of each bucket from before micro-batch ``number``, ascending."""
        out: dict[int, list[int]] = {}
        for version in sorted(int(v.split("=")[1]) for v in self._list(self.base) if v.startswith("version=")):
            if version < number:
                for b in self._list(f"{self.base}/version={version}"):
                    if b.startswith("bucket="):
                        out.setdefault(int(b.split("=")[1]), []).append(version)
        return out

    def mark(self, number: int):
        """Newest event time before micro-batch ``number``; None if there was none."""
        known = [int(v.split("=")[1]) for v in self._list(f"{self.base}/marks")]
        last = max((v for v in known if v < number), default=None)
        return None if last is None else self.spark.read.schema("at timestamp").parquet(f"{self.base}/marks/batch={last}").first()[0]

    def advance(self, batch: DataFrame, number: int, step: Step, write: Callable[[DataFrame], None]) -> None:
        found = batch.groupBy(self.bucket(step.key).alias("b")).agg(F.max("event_time").alias("at")).collect()  # a row per bucket at most
        if not found:
            return
        versions, mark = self.versions(number), self.mark(number)
        touched = {r["b"] for r in found} | (set(versions) if number and number % self.sweep == 0 else set())
        paths = [f"{self.base}/version={versions[b][-1]}/bucket={b}" for b in sorted(touched) if b in versions]
        before = self.spark.read.parquet(*paths) if paths else None
        if before is not None and mark is not None:
            before = before.where(F.col("until") >= F.lit(mark))
        out, now = step.run(batch, before)
        write(out)
        if before is not None:
            now = now.unionByName(before.join(now.select(F.col("key").alias("_k")), F.col("key").eqNullSafe(F.col("_k")), "left_anti"))
        now.withColumn("bucket", self.bucket("key")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/version={number}")
        newest = max([r["at"] for r in found if r["at"]] + [mark] * (mark is not None), default=None)
        self.spark.createDataFrame([(newest,)], "at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/marks/batch={number}")
        self._forget(touched, versions, number)

    def _forget(self, touched: set[int], versions: dict[int, list[int]], number: int) -> None:
        written = set(self._list(f"{self.base}/version={number}"))
        # A bucket without a row left has no new version, and a replay would find all of its rows forgotten as well.
        gone = [(b, old) for b in touched for old in (versions.get(b, [])[:-1] if f"bucket={b}" in written else versions.get(b, []))]
        for b, old in gone:
            self._remove(f"{self.base}/version={old}/bucket={b}")
        for old in {old for _, old in gone}:
            if not [x for x in self._list(f"{self.base}/version={old}") if x.startswith("bucket=")]:
                self._remove(f"{self.base}/version={old}")
        for m in self._list(f"{self.base}/marks"):
            if int(m.split("=")[1]) < number - 1:
                self._remove(f"{self.base}/marks/{m}")


#: Buckets of a job's state, and micro-batches between two sweeps.
STATE_BUCKETS, SWEEP = 64, 100


def fold_to_table(stream: DataFrame, name: str, step: Step, newest_by: list[str] | None = None, buckets: int = STATE_BUCKETS, sweep: int = SWEEP, base: str | None = None) -> DataFrame:
    """Run a step over all available input; state is kept by :class:`BucketState`, so a micro-batch writes in proportion to its keys.

    Each micro-batch writes output and state under its own number, so a replayed batch overwrites itself. The step is batch code: it
    can split a key over tasks. The result is all output, or with ``newest_by`` the newest row of these columns.
    """
    spark = stream.sparkSession
    base = base or _folder(spark, name)
    state = BucketState(spark, f"{base}/state", buckets, sweep)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            state.advance(batch, number, step, lambda out: out.write.mode("overwrite").parquet(f"{base}/data/batch={number}"))
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{base}/data").parquet(f"{base}/data")
    return _newest(rows, newest_by) if newest_by else rows.drop("batch")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest batch per key: combined before the shuffle."""
    columns = [c for c in rows.columns if c != "batch"]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row"))
    return best.select("row.*")


def update_to_table(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode aggregation; each micro-batch writes its changed rows under its own number, so a
    replayed batch overwrites itself. The newest row per key is the result."""
    spark = stream.sparkSession
    base = _folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{base}/data").parquet(f"{base}/data")
    return _newest(rows, keys)

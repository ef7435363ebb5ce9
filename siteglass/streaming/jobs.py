"""Streaming forms of the time-driven behaviours. Windowed counts use built-in aggregation;
change detection, budgets, life cycles and running counters are batch steps over bucketed state, which can split a key; cool-downs use
a stateful processor with timers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.machine import run_machine
from ..operators.ordered import running_before, with_previous
from ..operators.tables import ENDED, RUN_STATUSES
from .sources import Step

# --- fixed values --------------------------------------------------------------------
RATE_WINDOW, RATE_LIMIT = "15 minutes", 100
USAGE_WINDOW = "60 seconds"
COOL_DOWN_SECONDS = 60
ROBOTS_TTL_SECONDS = 3600
MAX_ATTEMPTS = 3
# Status a run takes on, and the statuses it may come from (None: any).
TRANSITIONS = {
    "start": ("running", ("queued",)),
    "pause": ("paused", ("running", "queued")),
    "resume": ("running", ("paused",)),
    "complete": ("completed", None),
    "fail": ("failed", None),
}
# ---------------------------------------------------------------------------------------


def over_rate(events: DataFrame, limit: int = RATE_LIMIT, late: str = "1 hour") -> DataFrame:
    """Clients with more than ``limit`` requests in a tumbling window."""
    counted = events.withWatermark("event_time", late).groupBy(F.window("event_time", RATE_WINDOW), "client").agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > limit).select(F.col("window.start").alias("window_start"), "client", "requests")


def _until(at: Column, ttl: str) -> Column:
    return (at + F.expr(f"INTERVAL {ttl}")).alias("until")


def running_totals(key: str, totals: Mapping[str, Column], ended: Column | None = None, ttl: str = "90 days", grace: str = "1 hour") -> Step:
    """Step: key and running totals of the keys of each micro-batch.

    ``totals``: name and what a row adds. A key is remembered for ``ttl`` after its last event, and only for ``grace`` once a row of it has ``ended``;
    then its state goes, its totals stay in the output, and a key that comes back counts anew.
    """

    def run(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        over = F.max(F.coalesce(ended, F.lit(False))) if ended is not None else F.lit(False)
        sums = batch.groupBy(F.col(key).alias("key")).agg(*[F.sum(c).cast("long").alias(f"_{n}") for n, c in totals.items()], over.alias("over"), F.max("event_time").alias("at"))
        if before is not None:
            sums = sums.join(before.select(F.col("key").alias("_k"), *totals, F.col("ended").alias("was")), F.col("key").eqNullSafe(F.col("_k")), "left")
        old = (lambda n: F.coalesce(n, F.lit(0))) if before is not None else (lambda n: F.lit(0))
        now = sums.select(
            "key", *[(old(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in totals],
            (F.col("over") | F.coalesce("was", F.lit(False)) if before is not None else F.col("over")).alias("ended"), "at",
        ).withColumn("until", F.when(F.col("ended"), _until(F.col("at"), grace)).otherwise(_until(F.col("at"), ttl)))
        return now.select("key", *totals), now.drop("at")

    return Step(key, run)


def run_progress(key: str, discovered: Column, processed: Column, ended: Column | None = None, ttl: str = "90 days") -> Step:
    """Step: counters of each run; those of an ended run leave the state after an hour."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return running_totals(key, {"events": F.lit(1), "pages_discovered": one(discovered), "pages_processed": one(processed)}, ended, ttl)


def usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Request counters per endpoint and minute."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", USAGE_WINDOW), "endpoint").agg(
        F.count("*").alias("total"), F.count_if(F.col("status_code") < 400).alias("success"), F.count_if(F.col("status_code") >= 400).alias("errors")
    ).select(F.col("window.start").alias("window_start"), "endpoint", "total", "success", "errors")


def first_submissions(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Job ids once each, however often they are submitted inside the watermark."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["job_id"]).select("job_id")


def attempts(key: str, done: Column | None = None, ttl: str = "7 days") -> Step:
    """Step: submissions of each job so far; a job that is ``done`` or isn't submitted again within ``ttl`` leaves the state."""
    return running_totals(key, {"attempts": F.lit(1)}, done, ttl)


def may_retry(counted: DataFrame) -> DataFrame:
    return counted.withColumn("may_retry", F.col("attempts") < MAX_ATTEMPTS)


class CoolDown(StatefulProcessor):
    """A key's events spaced by a gap. Only (id, time) of one micro-batch is held per key, and the time of the last allowed event as state.

    Once the watermark is past the gap every event still to come is allowed anyway; an event-time timer then drops the state.
    """

    def __init__(self, gap: int):
        self._gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["micros"].to_numpy(np.int64), r["event_id"].to_numpy(np.int64)) for r in rows]
        micros, ids = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, micros))
        micros, ids = micros[order], ids[order]
        last = self._last.get()[0] if self._last.exists() else None
        allowed = np.zeros(len(ids), bool)
        # From one allowed event to the first that is a gap later.
        at = 0 if last is None else int(np.searchsorted(micros, last + self._gap))
        while at < len(ids):
            allowed[at], last = True, int(micros[at])
            at = max(at + 1, int(np.searchsorted(micros, last + self._gap)))
        self._last.update((last,))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer((last + self._gap) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "event_id": ids, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._last.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def _keyed(events: DataFrame, key: str, value: Column) -> DataFrame:
    return events.select(F.col(key).alias("key"), "event_id", "event_time", value.alias("value"))


def _with_state(rows: DataFrame, before: DataFrame | None, column: str, kind: str) -> DataFrame:
    if before is None:
        return rows.withColumn(column, F.lit(None).cast(kind))
    return rows.join(before.select(F.col("key").alias("_k"), column), F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k")


def content_changes(key: str, content_hash: Column, bucket: str = "hour", ttl: str = "90 days") -> Step:
    """Step: key, event_id of snapshots whose content differs from the key's previous one.

    Inside a micro-batch previous is by time and id, before that it is the last of the micro-batch before: a snapshot is compared
    on arrival. A key is sorted in slices of ``bucket``; keys idle for ``ttl`` are forgotten, and count as new.
    """

    def run(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = _keyed(batch, key, content_hash)
        near = _with_state(with_previous(rows, ["key"], F.date_trunc(bucket, "event_time"), ["event_time", "event_id"], "value", "_prev"), before, "last", "struct<value: string>")
        changed = near.filter(~F.coalesce(F.coalesce("_prev", "last")["value"].eqNullSafe(F.col("value")) & F.coalesce("_prev", "last").isNotNull(), F.lit(False)))
        order = F.struct("event_time", "event_id")
        now = rows.groupBy("key").agg(F.max_by(F.struct("value"), order).alias("last"), _until(F.max("event_time"), ttl))
        return changed.select("key", "event_id"), now

    return Step(key, run)


def within_token_budget(key: str, tokens: Column, limit: int, bucket: str = "hour", ttl: str = "90 days") -> Step:
    """Step: key, event_id of the items scored before the key's budget was used up (the last may overshoot).

    Tokens are at least zero. Order and expiry are those of :func:`content_changes`.
    """

    def run(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = _keyed(batch, key, F.coalesce(tokens, F.lit(0)).cast("long"))
        running = running_before(rows, ["key"], F.date_trunc(bucket, "event_time"), [F.col("event_time"), F.col("event_id")], F.col("value"), "earlier")
        kept = _with_state(running, before, "used", "long").filter(F.coalesce("used", F.lit(0)) + F.col("earlier") < limit)
        sums = _with_state(rows.groupBy("key").agg(F.sum("value").alias("now"), F.max("event_time").alias("at")), before, "used", "long")
        now = sums.select("key", (F.coalesce("used", F.lit(0)) + F.col("now")).alias("used"), _until(F.col("at"), ttl))
        return kept.select("key", "event_id"), now

    return Step(key, run)


def cool_down(events: DataFrame, key: str, seconds: int = COOL_DOWN_SECONDS, late: str = "1 hour") -> DataFrame:
    """key, event_id, allowed: an event is allowed when the key's last allowed one is ``seconds`` old or more.

    A key's state goes once the watermark (``late`` behind the newest event) is past the gap. Events behind the watermark are dropped,
    and so are events without a time.
    """
    shaped = events.where(F.col("event_time").isNotNull()).withWatermark("event_time", late).select(F.col(key).alias("key"), "event_id", F.unix_micros("event_time").alias("micros"), "event_time")
    return shaped.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CoolDown(seconds * 1_000_000), outputStructType="key long, event_id long, allowed boolean", outputMode="Append", timeMode="EventTime",
    )


def life_cycle(key: str, action: Column, bucket: str = "hour", ttl: str = "90 days", grace: str = "7 days") -> Step:
    """Step: key, event_id, status after the event, accepted; an illegal action changes nothing. A run starts queued.

    A run's events are a scan over transition functions, so a run with most of the rows is many tasks. Its status is remembered for ``ttl`` after its
    last event, that of an ended run for ``grace``; a run that comes back later starts queued.
    """

    def run(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = _keyed(batch, key, action)
        started = None if before is None else before.select("key", "status")
        done = run_machine(rows, ["key"], F.date_trunc(bucket, "event_time"), [F.col("event_time"), F.col("event_id")], F.col("value"), TRANSITIONS, RUN_STATUSES, started)
        last = done.groupBy("key").agg(F.max_by("status", F.struct("event_time", "event_id")).alias("status"), F.max("event_time").alias("at"))
        until = F.when(F.col("status").isin(*ENDED), _until(F.col("at"), grace)).otherwise(_until(F.col("at"), ttl))
        return done.select("key", "event_id", "status", "accepted"), last.select("key", "status", until.alias("until"))

    return Step(key, run)

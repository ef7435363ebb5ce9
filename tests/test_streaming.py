"""Streaming results equal batch results, also when the input arrives in several micro-batches."""

from __future__ import annotations

import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import Window, functions as F

from siteglass.operators.machine import run_machine
from siteglass.operators.tables import RUN_STATUSES
from siteglass.plans.analysis import analyze
from siteglass.sources.pages import read_pages, stream_pages
from siteglass.streaming import jobs
from siteglass.streaming.sources import BucketState, append_to_table, fold_to_table, read_events, update_to_table


@pytest.fixture(scope="module")
def split(spark, folder):
    """Events written as four files in time order."""
    base = tempfile.mkdtemp(prefix="spark-")
    events = spark.read.parquet(f"{folder}/events.parquet")
    for i in range(4):
        part = events.filter(F.floor(F.col("event_id") / 250) == i)
        part.coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    return base


def test_changes_across_batches(spark, split):
    events = read_events(spark, split, files_per_trigger=1)
    got = fold_to_table(events, "t", jobs.content_changes("user_id", F.sha2("event_type", 256)))
    batch = spark.read.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{split}/events.parquet")
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    want = batch.withColumn("p", prev).filter(~F.col("p").eqNullSafe(F.col("event_type"))).select("event_id")
    assert got.select("event_id").exceptAll(want).isEmpty() and got.count() == want.count()


def test_usage_across_batches(spark, split):
    events = read_events(spark, split, files_per_trigger=1)
    shaped = events.select("event_time", F.col("event_type").alias("endpoint"), F.lit(200).alias("status_code"))
    got = update_to_table(jobs.usage(shaped), "u", ["window_start", "endpoint"])
    assert got.agg(F.sum("total")).collect()[0][0] == 1000


def _write_events(spark, base, name, rows):
    spark.createDataFrame(rows, "event_id long, minute int, user_id long, event_type string, value double").select(
        "event_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("minute"))).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"),
    ).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    return name


def test_late_rows_are_dropped_and_windows_closed(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    for i, minute in enumerate((0, 300, 600, 1, 601)):  # the fourth is ten hours late
        _write_events(spark, base, i, [(i, minute, 1, "view", 1.0)])
    shaped = read_events(spark, base, files_per_trigger=1).select("event_time", F.col("event_type").alias("endpoint"), F.lit(200).alias("status_code"))
    got = {r["window_start"].strftime("%H:%M"): r["total"] for r in update_to_table(jobs.usage(shaped), "late", ["window_start", "endpoint"]).collect()}
    assert got == {"00:00": 1, "05:00": 1, "10:00": 1, "10:01": 1}


def test_budget_and_changes_carry_state_and_expire(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    batches = [[(0, 0, 1, "a", 60.0), (1, 1, 1, "a", 30.0), (2, 2, 2, "a", 10.0), (3, 2, None, "x", 99.0)], [(4, 10, 1, "a", 20.0), (5, 11, 1, "b", 20.0), (6, 12, None, "x", 9.0)], [(7, 60 * 24 * 99, 1, "b", 5.0), (8, 60 * 24 * 99, 2, "a", 5.0)]]
    for i, rows in enumerate(batches):
        _write_events(spark, base, i, rows)
    read = lambda: read_events(spark, base, files_per_trigger=1)
    changes = {r["event_id"] for r in fold_to_table(read(), "c", jobs.content_changes("user_id", F.col("event_type"), ttl="200 days")).collect()}
    assert changes == {0, 2, 3, 5}
    again = {r["event_id"] for r in fold_to_table(read(), "c", jobs.content_changes("user_id", F.col("event_type"), ttl="1 hour")).collect()}
    assert again == {0, 2, 3, 5}  # keys of the last micro-batch were read before they expired
    kept = {r["event_id"] for r in fold_to_table(read(), "b", jobs.within_token_budget("user_id", F.col("value"), 100)).collect()}
    assert kept == {0, 1, 2, 3, 4, 6, 8}


def test_life_cycle_rejects_illegal(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    actions = ["resume", "start", "start", "pause", "start", "resume", "complete", "pause"]
    rows = [(i, 1, a) for i, a in enumerate(actions)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").select(
        "event_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("event_id").cast("int"))).cast("timestamp_ntz").alias("ts"), "user_id", "event_type",
        F.lit(0.0).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(f"{base}/events.parquet")
    table = fold_to_table(read_events(spark, base), "l", jobs.life_cycle("user_id", F.col("event_type"))).orderBy("event_id").collect()
    assert [(r["status"], r["accepted"]) for r in table] == [
        ("queued", False), ("running", True), ("running", False), ("paused", True), ("paused", False), ("running", True), ("completed", True), ("completed", False)]


def test_budget_and_cool_down(spark, split):
    events = read_events(spark, split, files_per_trigger=2)
    kept = fold_to_table(events, "b", jobs.within_token_budget("user_id", F.floor("value"), 100))
    first = append_to_table(jobs.cool_down(read_events(spark, split), "user_id", 10**9), "c").filter("allowed")
    users = spark.read.parquet(f"{split}/events.parquet").select("user_id").distinct().count()
    assert first.count() == users and kept.select("key").distinct().count() == users


def test_pages_are_scored_as_a_stream(spark, folder):
    base = tempfile.mkdtemp(prefix="spark-")
    pages = read_pages(spark, f"{folder}/pages.parquet")
    pages.repartition(3).write.mode("overwrite").parquet(f"{base}/pages")
    got = append_to_table(analyze(stream_pages(spark, f"{base}/pages", files_per_trigger=2)).select("page_id", "overall_score"), "p")
    want = analyze(pages).select("page_id", "overall_score")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


# --- state ---------------------------------------------------------------------------------

def _buckets(base):
    """Versions on disk by bucket."""
    out = {}
    for p in Path(base.removeprefix("file:"), "state").glob("version=*/bucket=*"):
        out.setdefault(p.name, []).append(int(p.parent.name.split("=")[1]))
    return out


def test_a_batch_writes_the_buckets_of_its_keys(spark):
    base, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    _write_events(spark, base, 0, [(i, 0, i, "a", 1.0) for i in range(400)])
    for k in range(1, 5):
        _write_events(spark, base, k, [(1000 * k, k, 7, "b", 1.0), (1000 * k + 1, k, 8, "a", 1.0)])
    step = jobs.content_changes("user_id", F.col("event_type"))
    got = {r["event_id"] for r in fold_to_table(read_events(spark, base, files_per_trigger=1), "c", step, buckets=32, base=out).collect()}
    assert got == {*range(400), 1000}
    versions = _buckets(out)
    hot = {b for b, v in versions.items() if max(v) > 0}
    assert len(versions) == 32 and 1 <= len(hot) <= 2
    assert all(sorted(versions[b]) == [3, 4] for b in hot) and all(versions[b] == [0] for b in set(versions) - hot)
    # Batches of two keys write far less than the one of 400.
    size = {n: sum(f.stat().st_size for f in Path(out, "state").glob(f"version={n}/*/*.parquet")) for n in (0, 4)}
    assert 0 < size[4] < size[0] / 8
    assert len(list(Path(out, "state", "marks").iterdir())) == 2


def test_a_replayed_batch_overwrites_itself(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    state = BucketState(spark, base, 4, 100)
    step, seen = jobs.within_token_budget("user_id", F.col("value"), 100), []
    rows = lambda *r: spark.createDataFrame(r, "event_id long, user_id long, value double, minute int").withColumn("event_time", F.timestamp_seconds(F.col("minute") * 60))
    first, second = rows((1, 1, 60.0, 1), (2, 2, 1.0, 1)), rows((3, 1, 50.0, 2), (4, 1, 50.0, 3))
    for number, batch in ((0, first), (1, second), (1, second), (1, second)):
        state.advance(batch, number, step, lambda out: seen.append(sorted(r["event_id"] for r in out.collect())))
    assert seen == [[1, 2], [3], [3], [3]]


def test_sweep_drops_forgotten_keys(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    state = BucketState(spark, base, 8, 2)
    step = jobs.within_token_budget("user_id", F.col("value"), 100, ttl="1 day")
    for number in range(5):
        keys = range(50) if number == 0 else [1]
        batch = spark.createDataFrame([(number * 100 + k, k, 1.0, number * 5) for k in keys], "event_id long, user_id long, value double, day int")
        state.advance(batch.withColumn("event_time", F.timestamp_seconds(F.col("day") * 86400)), number, step, lambda out: out.collect())
    # The sweeps of batches 2 and 4 rewrote every bucket; no old version and no forgotten key is left but in what a replay would need.
    newest = {b: v[-1] for b, v in state.versions(99).items()}
    rows = spark.read.parquet(*[f"{base}/version={v}/bucket={b}" for b, v in newest.items() if Path(base, f"version={v}", f"bucket={b}").exists()]).collect()
    assert [r["key"] for r in rows] == [1]


def _ordered(rows):
    """Statuses by a plain walk."""
    out, now = {}, {}
    for event, _, key, action in sorted(rows, key=lambda r: (r[1], r[0])):
        target, sources = jobs.TRANSITIONS.get(action, (None, ()))
        status = now.get(key, "queued")
        legal = target is not None and (sources is None or status in sources)
        now[key] = target if legal else status
        out[event] = now[key], legal
    return out


@pytest.mark.parametrize("span", [2, 5, 256])
def test_machine_against_a_plain_walk(spark, span):
    r = random.Random(span)
    actions = ["start", "pause", "resume", "start", "pause", "resume", "complete", "fail", "other", None]
    rows = [(i, r.randrange(3000), 1 if r.random() < 0.4 else r.choice([None, *range(40)]), r.choice(actions if r.random() < 0.05 else actions[:6])) for i in range(900)]
    frame = spark.createDataFrame(rows, "id long, minute int, run long, action string").repartition(5)
    got = run_machine(frame, ["run"], F.floor(F.col("minute") / 60), [F.col("minute"), F.col("id")], F.col("action"), jobs.TRANSITIONS, RUN_STATUSES, span=span)
    assert {x["id"]: (x["status"], x["accepted"]) for x in got.collect()} == _ordered(rows)
    assert run_machine(frame.limit(0), ["run"], F.col("minute"), [F.col("id")], F.col("action"), jobs.TRANSITIONS, RUN_STATUSES).collect() == []


def test_life_cycle_over_batches_and_ended_runs_leave(spark):
    base, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    _write_events(spark, base, 0, [(0, 0, 1, "start", 0.0), (1, 0, 2, "start", 0.0), (2, 1, 2, "complete", 0.0), (3, 1, 3, "pause", 0.0)])
    _write_events(spark, base, 1, [(4, 10, 1, "pause", 0.0), (5, 10, 2, "start", 0.0), (6, 10, 3, "resume", 0.0)])
    _write_events(spark, base, 2, [(7, 60 * 24 * 9, 1, "resume", 0.0)])
    _write_events(spark, base, 3, [(8, 60 * 24 * 9 + 1, 2, "start", 0.0), (9, 60 * 24 * 9 + 1, 3, "complete", 0.0)])
    table = fold_to_table(read_events(spark, base, files_per_trigger=1), "l", jobs.life_cycle("user_id", F.col("event_type")), buckets=1, base=out).collect()
    got = {r["event_id"]: (r["status"], r["accepted"]) for r in table}
    assert got[4] == ("paused", True) and got[5] == ("completed", False) and got[6] == ("running", True) and got[7] == ("running", True)
    assert got[8] == ("running", True)  # ended eight days before: forgotten
    assert got[9] == ("completed", True)


def test_totals_of_ended_keys_leave_the_state(spark):
    base, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for i, minute in enumerate((0, 30, 60 * 24, 60 * 24 + 5)):
        kind = "end" if i == 1 else "view"
        _write_events(spark, base, i, [(100 * i + k, minute, k, kind if k < 10 else "view", 0.0) for k in (range(20) if i < 2 else [15])])
    step = jobs.run_progress("user_id", F.col("event_type") == "view", F.col("event_type") == "end", ended=F.col("event_type") == "end")
    got = {r["key"]: (r["events"], r["pages_discovered"], r["pages_processed"]) for r in fold_to_table(read_events(spark, base, files_per_trigger=1), "p", step, ["key"], buckets=1, base=out).collect()}
    assert got == {k: (2, 1, 1) if k < 10 else (4, 4, 0) if k == 15 else (2, 2, 0) for k in range(20)}
    left = {n: spark.read.parquet(f"{out}/state/version={n}").count() for n in (2, 3)}
    assert left == {2: 20, 3: 10}  # the ten ended runs went once an hour had passed


def test_cool_down_state_empties(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    _write_events(spark, base, 0, [(k, 0, k, "view", 0.0) for k in range(10)] + [(20, 5, 1, "view", 0.0), (21, 30, 1, "view", 0.0)])
    for i, minute in enumerate((600, 1200, 1201), start=1):
        _write_events(spark, base, i, [(100 * i, minute, 77, "view", 0.0)])
    _write_events(spark, base, 4, [(500, 2, 3, "view", 0.0), (501, 1202, 3, "view", 0.0)])  # the first of them is late
    stream = jobs.cool_down(read_events(spark, base, files_per_trigger=1), "user_id", 600)
    folder = tempfile.mkdtemp(prefix="spark-")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{folder}/data").collect()}
    assert got == {**dict.fromkeys(range(10), True), 20: False, 21: True, 100: True, 200: True, 300: False, 501: True}
    left = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "last").load()
    assert {r["key"]["key"] for r in left.collect()} <= {77, 3}

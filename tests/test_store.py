"""Stored tables: changes are written, touch only their buckets, and can be replayed."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siteglass.operators import store

NOW = "2024-01-01"
PAGES = "project_id int, url_hash string, url string, page_type string, last_crawl_run_id int, first_discovered_at timestamp, last_crawled_at timestamp"
GIVEN = ["page_type", "last_crawl_run_id"]


def at(day):
    return F.lit(day).cast("timestamp")


def files(table):
    return {(p.parent.name, p.name): (p.stat().st_mtime_ns, p.stat().st_ino) for p in Path(table.path.removeprefix("file:")).rglob("*.parquet")}


@pytest.fixture
def pages(spark):
    rows = [(1, f"h{i}", f"u{i}", "blog", 5, None, None) for i in range(200)] + [(None, None, "u?", "blog", 5, None, None)]
    frame = spark.createDataFrame(rows, PAGES).withColumn("first_discovered_at", F.lit("2020-01-01").cast("timestamp"))
    return store.create(frame, ["project_id", "url_hash"], 8, name="pages")


def batch(spark, rows):
    return spark.createDataFrame(rows, "project_id int, url_hash string, url string, page_type string, last_crawl_run_id int, pos int")


def test_upsert_writes_the_touched_buckets_only(spark, pages):
    before = files(pages)
    rows = [(1, "h1", "u1", None, 9, 1), (1, "new", "n", "product", None, 2), (1, "new", "n2", None, None, 3)]
    touched = store.upsert_pages(pages, batch(spark, rows), 1, at(NOW), GIVEN)
    after = files(pages)
    same = {f for f in before if before[f] == after.get(f)}
    assert len(touched) in (1, 2) and {f"bucket={n}" for n in range(8)} - {b for b, _ in same} == {f"bucket={n}" for n in touched}
    got = {r["url_hash"]: r for r in pages.read().collect()}
    assert len(got) == 202
    assert got["h1"]["page_type"] == "blog" and got["h1"]["last_crawl_run_id"] == 9 and got["h1"]["first_discovered_at"].year == 2020 and got["h1"]["last_crawled_at"].year == 2024
    assert got["new"]["url"] == "n" and got["new"]["page_type"] == "product" and got["new"]["first_discovered_at"].year == 2024 and got["new"]["last_crawled_at"] is None
    assert got["h2"]["last_crawled_at"] is None


def test_replayed_and_empty_batches_change_nothing(spark, pages):
    rows = batch(spark, [(1, "h1", "u1", "faq", 9, 1), (None, None, "u?", "x", None, 2)])
    store.upsert_pages(pages, rows, 7, at(NOW), GIVEN)
    once = pages.read().collect()
    store.upsert_pages(pages, rows, 7, at("2030-01-01"), GIVEN)
    assert sorted(map(str, pages.read().collect())) == sorted(map(str, once))
    assert [r["page_type"] for r in pages.read().filter("url_hash is null").collect()] == ["x"]
    before = files(pages)
    assert store.upsert_pages(pages, batch(spark, []), 8, at(NOW), GIVEN) == [] and files(pages) == before


def test_a_failed_change_leaves_the_table(spark, pages):
    before = files(pages)

    def broken(rows, changes):
        return rows.withColumn("url", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        pages.change(batch(spark, [(1, "h1", "u1", "x", 1, 1)]), broken)
    assert files(pages) == before


def test_counts_are_added_once(spark):
    runs = spark.createDataFrame([(i, 10, None) for i in range(50)], "run_id long, pages long, tokens long")
    table = store.create(runs, ["run_id"], 4)
    deltas = spark.createDataFrame([(3, 1, 5)] * 1000 + [(4, 2, None), (999, 1, 1)], "run_id long, pages long, tokens long")  # a hot run
    for _ in range(3):
        store.add_counts(table, deltas, 1, ["pages", "tokens"])
    store.add_counts(table, deltas.limit(1), 2, ["pages", "tokens"])
    got = {r["run_id"]: (r["pages"], r["tokens"]) for r in table.read().collect()}
    assert len(got) == 50 and got[3] == (1011, 5005) and got[4] == (12, 0) and got[5] == (10, None)


def test_runs_end_once(spark):
    runs = spark.createDataFrame([(1, "running", None), (2, "queued", None), (3, "failed", None)], "run_id long, status string, completed_at timestamp")
    table = store.create(runs, ["run_id"], 4)
    store.update_runs(table, spark.createDataFrame([(1, "completed"), (2, None)], "run_id long, status string"), 1, at(NOW), ["status"])
    store.update_runs(table, spark.createDataFrame([(1, "failed")], "run_id long, status string"), 2, at("2030-01-01"), ["status"])
    got = {r["run_id"]: (r["status"], r["completed_at"] and r["completed_at"].year) for r in table.read().collect()}
    assert got == {1: ("failed", 2024), 2: ("queued", None), 3: ("failed", None)}


def test_deleting_all_of_a_bucket(spark):
    scores = spark.createDataFrame([(i % 6, i) for i in range(60)] + [(1, 100 + i) for i in range(500)], "page_id long, score_id long")
    table = store.create(scores, ["page_id"], 64)
    before = files(table)
    store.delete_children(table, spark.createDataFrame([(1,), (1,), (77,)], "page_id long"))
    left = {r["page_id"] for r in table.read().collect()}
    assert left == {0, 2, 3, 4, 5} and table.read().count() == 50
    assert all(files(table)[f] == before[f] for f in files(table)) and len({b for b, _ in before}) - len({b for b, _ in files(table)}) == 1

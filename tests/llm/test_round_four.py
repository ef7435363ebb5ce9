"""Tables that Spark sizes too low are not broadcast."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from siteglass.llm import decontamination, simhash


def executed(frame):
    rows = frame.collect()
    return rows, frame._jdf.queryExecution().executedPlan().toString()


# --- op2 -----------------------------------------------------------------------------------

def test_exploded_keys_are_never_broadcast(spark):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(300)]
    values = sorted({v ^ (sum(1 << b for b in r.sample(range(63), n))) for v in base for n in range(6)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    rows, plan = executed(simhash.similar_fingerprints(fps))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert {(r.a, r.b) for r in rows} == {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= 4}


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_crowded_keys_broadcast_or_shuffled(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    r = random.Random(5)
    values = {0} | {sum(1 << b for b in r.sample(range(60), r.randint(1, 3))) for _ in range(150)} | {r.getrandbits(62) for _ in range(150)}
    fps = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    links = simhash.connecting_links(fps, crowd=20).collect()
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    def classes(pairs):
        parent.update((v, v) for v in values)
        for a, b in pairs:
            parent[root(a)] = root(b)
        groups = {}
        for v in values:
            groups.setdefault(root(v), set()).add(v)
        return {frozenset(g) for g in groups.values()}

    got = classes((x.a, x.b) for x in links)
    assert got == classes((a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4)


# --- pipeline ------------------------------------------------------------------------------

def test_documents_are_not_broadcast_to_the_rows_that_stay(spark, tmp_path):
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "haven"]
    rows = [(i, " ".join(words[(i // 2 * 7 + j * j + j // 8 * (i // 2)) % 8] for j in range(400)) * 20) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got, plan = executed(simhash.without_near_duplicates(spark.read.parquet(str(tmp_path / "docs"))))
    assert not re.search(r"Join \[mark#\d+L?\], \[mark#\d+L?\], Inner", plan)
    ids = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).select("component_id").distinct()
    assert sorted(r.doc_id for r in got) == sorted(r.component_id for r in ids.collect())


def test_document_windows_are_not_broadcast_to_a_large_benchmark(spark, monkeypatch):
    item = "which of the seven old bridges crosses the narrow river near the castle"
    docs = spark.createDataFrame([(1, f"we ask {item} again"), (2, "nothing of the kind is found in this text at all today")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, item)], "item_id long, text string")
    wanted = decontamination.contamination(docs, benchmark).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    got, plan = executed(decontamination.contamination(docs, benchmark))
    assert got == wanted and [(r.doc_id, r.item_id) for r in got] == [(1, 10)]
    assert re.search(r"SortMergeJoin \[h#\d+L\]", plan) and not re.search(r"BroadcastHashJoin \[h#\d+L\]", plan)

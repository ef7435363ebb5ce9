"""The inverted file against the exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteglass.operators import cells, vectors

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    middles = r.standard_normal((30, 16)) * 2
    rows = [(i, [float(c) for c in middles[i % 30] + r.standard_normal(16)]) for i in range(2000)]
    rows += [(3000 + i, rows[7][1]) for i in range(700)]  # a hot vector
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] * 16)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def asked(table):
    return table.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def test_every_vector_is_indexed_in_bounded_blocks(table, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 100)
    index = cells.build(table, cells=12)
    stored = index.vectors(table)
    assert stored.count() == 2700 == stored.select("vec_id").distinct().count()
    assert max(index.blocks) >= 7 and stored.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 200


def test_all_cells_probed_is_exact(table, asked, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 100)
    monkeypatch.setattr(cells, "QUERY_ROWS", 10)
    index = cells.build(table, cells=9)
    got = cells.search(index, asked, 5, 9).select("query_id", "vec_id", "rank")
    want = vectors.top_related(table, asked, 5, block_rows=300, query_rows=7).select("query_id", "vec_id", "rank")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 5 * 27


def test_recall_with_measured_probes(table, asked):
    index = cells.build(table)
    probes = cells.probes_for(index, table, asked, 5, 0.95)
    assert probes < len(index.centres) / 2
    measured = cells.recall_of(cells.search(index, asked, 5, probes), vectors.top_related(table, asked, 5)).first()
    assert measured["queries"] == 27 and measured["wanted"] == 135 and measured["recall"] >= 0.9


def test_odd_tables(spark, table):
    assert cells.build(spark.createDataFrame([], SCHEMA)) is None
    assert cells.build(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA)) is None
    with pytest.raises(ValueError):
        cells.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))
    one = cells.build(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA))
    none = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, vector array<double>")
    assert cells.search(one, none, 3, 5).collect() == []

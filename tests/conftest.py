from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from siteglass.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate columns over literal rows: evaluate(rows, schema, {name: column}) -> list of dicts."""

    def run(rows, schema, columns):
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        return [r.asDict(recursive=True) for r in frame.select(*[c.alias(n) for n, c in columns.items()]).collect()]

    return run

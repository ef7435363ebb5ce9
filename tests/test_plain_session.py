"""The library in a session it did not build: a plain builder, as a user or a driver makes it."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from siteglass.session import RUNTIME_CONF

ROOT = Path(__file__).resolve().parent.parent

#: The entry, and at least one query of each module of plans.
SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as driver
assert driver.entry(spark).count() == 50
made = driver.queries()
for name in ("url_forms", "sitemap_entries", "latest_snapshots", "stream_usage"):
    assert made[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("plain session ok")
"""


def test_every_setting_can_be_made_at_run_time(spark):
    assert [k for k in RUNTIME_CONF if k.startswith("spark.sql.") and not k.startswith("spark.sql.streaming.stateStore.rocksdb") and not spark.conf.isModifiable(k)] == []


def test_entry_and_queries_in_a_plain_session():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "plain session ok" in done.stdout, done.stderr[-3000:]

"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from siteglass.plans import catalog  # noqa: E402
from siteglass.session import build_session  # noqa: E402

HEADLINE = (
    "page_scores", "page_recommendations", "extract_text", "extract_links", "url_forms", "dedupe_urls", "page_list_sorted", "project_score_stats",
    "run_comparison", "run_comparison_summary", "changed_snapshots", "score_history", "budget_cut", "category_averages", "cached_scores", "tenant_scores",
    "text_features", "text_chunks", "token_stats", "crawl_frontier", "final_canonicals", "related_to_topic", "stream_content_changes", "stream_usage",
)

WARM = ("page_scores", "page_recommendations", "text_features", "changed_snapshots", "budget_cut", "run_comparison", "related_to_topic", "page_list_sorted")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = catalog.queries()
    # Start the JVM code paths and the Python workers once; queries themselves are not run before being timed.
    spark.read.parquet(f"{folder}/nation.parquet").mapInArrow(lambda batches: batches, "n_nationkey int, n_name string, n_regionkey int").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr)
    # Once more: what is left when plans, generated code and Python workers are warm.
    warm: dict[str, float] = {}
    for name in WARM:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        warm[name] = round(time.perf_counter() - start, 3)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "warm": warm, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch import catalog  # noqa: E402
from tidewatch.session import build_session, clear_scratch  # noqa: E402

HEADLINE = [
    "smart_merge", "merged_daily_metrics", "dimension_stats", "user_performance", "compute_analysis", "duration_percentiles", "item_type_performance",
    "fact_activity", "fact_daily_metrics", "fact_user_metrics", "top_workspaces", "by_environment", "measure_change_pct", "period_leaders_workspace",
    "order_status_mart", "hub_items", "item_centrality", "node_depths", "chain_stats", "access_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus if cpus.isdigit() else 8, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__checkpoint__dir=shared,
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.load()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        clear_scratch(spark)
    found = re.search(r"sf([0-9.]+)", os.path.basename(os.path.normpath(sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each figure is the median of warm runs into a sink that keeps nothing. ``landing`` is the
one-time cost of landing the derived tables."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "facet_counts", "facet_disjunctive", "facet_disjunctive_text", "filtered_total", "browse_page", "search_grouped",
    "collection_stats", "holder_rank", "rarity_score", "rarity_rank", "interval_rebuild", "chain_derive", "owner_asof",
    "last_activity", "integrity_owner_mismatch", "upsert_assets",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from vitrine.plans.registry import QUERIES
    from vitrine.sources.domain import Domain

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    start = time.perf_counter()
    d = Domain(spark, sf_dir)
    for table in (d.collections, d.asset_attributes, d.activity, d.assets, d.ownership_history, d.assets_by_id, d.attributes_by_asset):
        table()
    landing = time.perf_counter() - start
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "sum of median warm query times", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "landing": round(landing, 2), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Tables that come as one file of one row
group, which one task would read alone, are first written to a fresh folder in as many files as there are cores, as tables of
any size lie in a data lake. Every query runs once to warm up and is then timed over its complete result.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from auditframe.session import build_session
from checks import QUERIES
from checks.registry import BASE_TABLES

HEADLINE = (
    "P1_normalize_query", "A1_query_stats", "A2_cost_drivers", "K1_top_cost_drivers", "A4_workload_profile",
    "J1_missing_indexes", "J2_component_counts", "T1_redact_documents", "A9_tribal_knowledge",
    "A10_manual_operations", "P6_detect_language", "A5_repo_inventory", "C1_code_imports", "C3_code_sql",
    "C5_db_calls", "C8_scan_code", "A11_security_issues", "J3_code_db_edges", "G1_build_graph_edges",
    "G3_betweenness_hubs", "G4_simple_cycles", "L1_validate_transitions", "R1_latest_review_status",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    cores = spark.sparkContext.defaultParallelism
    with tempfile.TemporaryDirectory(prefix="bench-") as split_dir:
        for table in BASE_TABLES:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            rows.repartition(cores if rows.count() > 1000 else 1).write.parquet(f"{split_dir}/{table}.parquet")
        timings = measure(spark, split_dir)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf.group(1)) if sf else None,
    }))


def measure(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of each query's second run."""
    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(run(name), 3)
    return timings


if __name__ == "__main__":
    main()

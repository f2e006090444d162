"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "c0_elements", "c22_c23_links", "c44_counts", "p0_preflight", "rule_generic_link_text", "u1_canonicalize", "u8_links", "u11_robots_decisions", "u13_frontier", "u21_address_guard",
    "d1_d2_text_facts", "d5_inferred_headings", "d20_document_verdicts", "j6_unique_work", "j8_j11_budget", "o1_recent_scan", "o3_active_scans", "c46_keyboard_walk", "f8_conflicts",
    "x_nav_conflicts", "rule_component_identity", "v7_v14_review", "v16_failure_ranking", "t3_delta_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lucerna.plans import queries_site
    from lucerna.plans.registry import load_all
    from lucerna.session import local_session

    spark = local_session(cpus, "lucerna-bench", shuffle=int(cpus))
    registry = load_all()
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINES:
        queries_site._MEMO.clear()  # every query pays for its own stages
        start = time.time()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    out = {
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "pages": n_pages, "review_pages_per_second": round(n_pages / times["v7_v14_review"], 1),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()

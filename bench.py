"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pagequarry.session import local_session
from testkit import catalog

HEADLINE = (
    "page_profiles", "page_markup_facts", "elements", "internal_links", "html_resources", "findings_from_html", "technologies",
    "graph_nodes", "graph_edges", "shingles", "copy_groups", "similar_pairs", "first_comparisons", "duplicate_titles",
    "document_exposure", "scan_scores", "root_causes", "recommendations", "summaries", "executive_reports", "set_changes",
    "finding_changes", "competitor_scans", "robots_can_fetch", "target_policy", "reachable_pages", "admission",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=int(cores) if cores.isdigit() else 8)

    def run(name: str) -> float:
        started = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = time.time() - started
        print(f"{name} {took:.2f}s", file=sys.stderr, flush=True)
        return took

    times: dict[str, float] = {}
    run("home_pages")
    # From raw pages to scores; the queries after it read its stage tables.
    times["full_audit"] = round(run("scan_scores"), 3)
    catalog.audited(spark, folder, 2)
    for name in HEADLINE:
        times[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

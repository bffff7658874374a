"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local threads.
Deriving the lineage tables from the test tables is timed apart, as ``prepare``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandline.plans import catalog
from strandline.session import build_session
from strandline.sources.derived import World

HEADLINE = [
    "stale_steps", "dag_nodes_expanded", "artifact_states", "shared_path_stale_steps", "filtered_lineage", "lineage_jobs",
    "registration_jobs", "jobs_without_reruns", "step_identities", "step_numbers", "known_artifacts", "artifact_by_digest",
    "job_by_uid", "search_jobs", "job_log", "artifact_detail", "session_status", "classified_files", "syscall_file_sets",
    "process_summary", "redacted_commands", "redacted_documents", "matched_run_dirs", "dpkg_requirements", "packed_links",
    "orphaned_artifacts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    world = World(spark, folder)
    for view in ("jobs", "io", "job_outputs", "job_inputs", "artifacts", "artifact_hashes", "sessions", "run_files"):
        world.view(view)
    prepare = time.time() - start
    queries = catalog()
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name].run(World(spark, folder)).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "lineage_headline_queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "prepare": round(prepare, 3), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

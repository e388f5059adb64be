"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusctx.plans.queries import QUERIES  # noqa: E402
from corpusctx.session import local_session  # noqa: E402

HEADLINE = [
    "folder_tokens",
    "prompts",
    "files_classified",
    "files_classified_by_project",
    "task_selection",
    "files_under_roots",
    "prompt_parts",
    "prompt_totals",
    "task_manifest",
    "path_order",
    "folder_mapping",
    "registry_resolved",
    "slugs",
    "responses_parsed",
    "results_final",
    "secrets_masked",
    "run_costs",
]
RUNS = 3


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench", **{"spark.ui.showConsoleProgress": "false"})
    seconds = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)  # the first run warms up
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

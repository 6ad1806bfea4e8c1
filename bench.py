"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from skyledger.plans import registry  # noqa: E402
from skyledger.session import build_session  # noqa: E402

HEADLINE = (
    "monthly_disruption", "entity_disruption", "airport_role_disruption", "schedule_normalisation", "arrival_clock_check", "cohort_summary",
    "prior_month_counts", "prior_month_degrees", "airport_bins", "lookback_availability", "lookback_density", "lagged_association", "binary_metrics",
    "group_metrics", "review_capacity", "bootstrap_ap", "platt_fit", "rate_baselines", "episodes", "route_hhi", "betweenness", "gbt_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    queries["monthly_disruption"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times: dict[str, float] = {}
    for key in HEADLINE:
        started = time.perf_counter()
        queries[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

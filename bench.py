"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from terravane import catalog
from terravane.runtime import local_session

NAMES = [
    "dual_feed_distances", "nearest_infra_capped", "exclusion_mask", "score_default", "top_sites_diverse", "state_stats", "class_fraction_pivot",
    "zonal_slope_stats", "systemic_substations", "contract_split_clean", "epsilon_clusters", "endpoint_snap",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark, took = local_session(cpus, int(cpus)), {}
    for name in NAMES:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

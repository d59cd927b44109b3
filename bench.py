"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.plans import load_all
from graphloom.plans.registry import QUERIES
from graphloom.session import local_session

HEADLINE = [
    "corpus_entropy_curve",
    "laplacian_traces",
    "degree_comparison",
    "clustering_coefficient",
    "connected_components",
    "merge_close_nodes",
    "prune_edges",
    "betweenness_stars",
    "bootstrap_var_of_mean",
    "trajectory_nbest",
    "gradient_angles_sobel",
    "region_angle_histogram",
    "nearest_site",
    "exact_percentiles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(cpus)
    # first use compiles the Python workers and the JVM code paths
    QUERIES["degree_comparison"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()

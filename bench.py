"""Time the headline queries, the median of three runs after a warm one, and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from panelspark.operators import resample
from panelspark.plans import catalog, panel_queries

QUERIES = (
    "threshold_sharpe", "hac_sharpe", "bandwidth_sweep", "bootstrap_stationary", "romano_wolf", "permutation_draws",
    "cost_sensitivity", "walk_forward", "row_boundary", "candidate_gates",
)
RUNS, FULL_PERMS = 3, 10_000


def full_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``permutation_draws`` at full scale, which its SQL form is too slow for."""
    own = panel_queries.ship_panel(spark, sf_dir)
    return resample.permuted_sharpe(own, panel_queries.THRESHOLDS, FULL_PERMS, panel_queries.SEED, panel_queries.WEEKS)


def main() -> None:
    """Run on local cores over ``BENCH_SF_DIR``."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}
    found["permutation_draws_10000"] = full_permutations
    found["threshold_sharpe"](spark, sf_dir).collect()
    for name in (*QUERIES, "permutation_draws_10000"):
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            found[name](spark, sf_dir).collect()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

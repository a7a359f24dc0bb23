"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

import json
import os
import sys
import time

from checks.compare import session
from checks.queries import QUERIES

HEADLINE = (
    "booking_hash", "bronze_upsert", "silver_clean", "silver_merge",
    "avg_fare_by_airline", "avg_fare_by_class", "avg_fare_by_route", "seasonal_fare_variation",
    "booking_count_by_airline", "top_routes", "ml_features", "bronze_gate", "dq_suite",
    "fare_histogram", "fare_boxplot", "correlation_matrix", "describe_numeric",
    "scaled_features", "onehot_features", "model_metrics", "score_batch",
    "csv_scan", "csv_to_bronze", "publish_rebucketed", "tree_models", "train_linear",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"), "16g")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every row and column, and brings none of them to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("avg_fare_by_class")  # start the engine
    seconds = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

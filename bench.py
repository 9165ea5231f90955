"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from isobar.session import build_session  # noqa: E402

HEADLINE = [
    "events_by_zone", "weather_features", "weather_etl_table", "label_heatwave", "label_rainfall",
    "lag_features", "rolling_prior", "streak_length", "gap_report", "monthly_trend",
    "entity_percentiles", "cyclone_prepare", "matrix_heatwave", "stratified_split", "standardize",
    "roc_auc", "classification_metrics", "drift_ks", "drift_report", "upsert_latest_wins",
    "upsert_table", "ingest_plan", "scan_station_filter", "train_heatwave",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")

    from isobar.plans.queries import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("label_heatwave")  # starts the JVM's code paths; not counted
    names = sys.argv[1:] or HEADLINE
    times = {name: run(name) for name in names}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

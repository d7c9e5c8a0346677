"""Time the headline reports. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query is planned and run in full into a no-op sink; the median of the runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from rollcall.catalog import all_entries
from rollcall.catalog.entries import Star
from rollcall.session import tune

HEADLINE = "q"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rollcall-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)

    def run(entry) -> float:
        start = time.perf_counter()
        entry.run(Star(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    headline = [e for e in all_entries() if e.name.startswith(HEADLINE)]
    run(headline[0])  # start-up of the JVM and code paths is not part of the figures
    timings = {e.name: round(statistics.median(run(e) for _ in range(runs)), 3) for e in headline}
    print(
        json.dumps(
            {
                "metric": "registry_reports_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "runs": runs,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

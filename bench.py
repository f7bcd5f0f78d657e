"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: cores (default 8). BENCH_RUNS: warm runs of each query, of
which the median counts (default 5).
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: Coverage, sweep arithmetic, lookup in both forms, both kinds of coalescing, many small keys.
HEADLINE = ("coverage", "coverage_tiled", "coverage_many_keys", "sub", "div", "add_disjoint_keys", "strand_merge_add", "cmp_ge", "keyed_interval_lookup", "keyed_interval_lookup_binned", "multi_point", "coverage_near", "run_encode", "shift_right", "to_ranges")


def main() -> None:
    from pyspark.sql import SparkSession

    from runweave.queries import QUERIES

    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        took[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()

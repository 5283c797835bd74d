"""Times the library's registered queries, the median of three warm runs of each, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from logweave.plans import catalog


#: Timed runs of a query, after one that compiles it and warms its files; a query that takes longer than LONG_S is timed once.
RUNS, LONG_S = 3, 5


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, run in catalog.QUERIES.items():
        seen = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
            if len(seen) > 1 and seen[-1] > LONG_S:
                break
        times[name] = round(statistics.median(seen[1:]), 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

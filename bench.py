"""Times the headline queries: one JSON line. Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_PREVIOUS."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

import pyspark

from ferrule.plans import decision_support, exercises
from ferrule.session import start_session

#: Slower than the previous results by this factor is reported.
REGRESSION = 1.2
EXTRA = ("agg_by_key_sorted", "cte_join_agg", "chained_exchange", "hash_exchange")


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = start_session("bench", f"local[{cpus}]", int(cpus), {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = {**decision_support.QUERIES, **{k: exercises.QUERIES[k] for k in EXTRA}}
    took, failed = {}, {}
    for name, query in todo.items():
        times = []
        try:
            for _ in range(runs + 1):  # the first run compiles
                start = time.perf_counter()
                query(spark, directory).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
            took[name] = round(statistics.median(times[1:]), 4)
        except Exception as e:  # a failure is recorded and the others still run
            failed[name] = str(e)[:300]
    sf = re.search(r"sf([\d.]+)", directory)
    out = {"metric": "total of median warm seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None, "cpus": int(cpus), "runs": runs, "shuffle_partitions": int(cpus), "spark": pyspark.__version__}
    if failed:
        out["failed"] = failed
    if previous := os.environ.get("BENCH_PREVIOUS"):
        with open(previous) as f:
            before = json.load(f).get("queries", {})
        out["slower"] = {k: round(v / before[k], 2) for k, v in took.items() if before.get(k) and v > REGRESSION * before[k]}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())

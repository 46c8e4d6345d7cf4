"""Bench: run every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query first runs once on the smallest data set (sf0.001): that compiles
its generated code, warms the JIT and starts Python workers — one-time costs
of a process that a long-running cluster job pays once.  The timed run is on
$BENCH_SF_DIR, fully evaluated with the ``noop`` sink (nothing is collected
to the driver).  Prints one JSON line: total seconds, per-query seconds, and
the warm-up (cold) seconds for reference.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citeline.plans.catalog import QUERIES  # noqa: E402
from citeline.session import local_session  # noqa: E402

WARMUP_DIR = "/root/testdata/sf0.001"


def run(spark, name: str, base: str) -> float:
    t0 = time.time()
    QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or sorted(QUERIES)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus != "*" else None)
    warm = os.environ.get("BENCH_WARMUP", WARMUP_DIR)
    cold, times = {}, {}
    for name in names:
        if warm and os.path.isdir(warm):
            cold[name] = run(spark, name, warm)
        times[name] = run(spark, name, base)
    sf = os.path.basename(base.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus,
                      "warmup_sf_dir": warm, "warmup_seconds": round(sum(cold.values()), 3)}))


if __name__ == "__main__":
    main()

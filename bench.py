"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run once to warm up, then timed ``$BENCH_REPS`` times (default 3)
with a no-op sink, which executes the whole plan without bringing rows to
the driver.  Prints one JSON line with the median per query and their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from acvlens.plans.registry import QUERIES  # noqa: E402
from acvlens.session import get_session  # noqa: E402


def _sf(sf_dir: str) -> float | str:
    tail = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    try:
        return float(tail.removeprefix("sf"))
    except ValueError:
        return tail


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="acvlens-bench")
    times: dict[str, float] = {}
    for name, q in QUERIES.items():
        if only and name not in only:
            continue
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": _sf(sf_dir),
        "cpus": cpus,
        "reps": reps,
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()

"""Warm median times of the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS (default 1),
BENCH_QUERIES (names, default the twelve documents and the heavier operators), BENCH_DUCKDB=1
adds the times of the equivalent SQL in DuckDB on the same machine.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wellspark.checks import REGISTRY  # noqa: E402
from wellspark.plans.recipes import RECIPES  # noqa: E402
from wellspark.session import local_session  # noqa: E402

HEADLINE = [
    *[f"doc_{asset}" for asset in RECIPES],
    "ordered_lists",
    "asset_counts",
    "clean_string",
    "curve_stats",
    "convex_hull",
    "catalog_upsert",
]


def timed(action, runs: int) -> float:
    action()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, partitions=int(cpus), memory="16g")

    def run(name):
        # Every column of every row is computed and thrown away.
        return lambda: REGISTRY[name][0](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {name: timed(run(name), runs) for name in names}
    out = {
        "metric": "sum of warm median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    if os.environ.get("BENCH_DUCKDB"):
        from wellspark.checks.compare import connect

        connection = connect(folder)
        connection.execute(f"SET threads = {cpus}")

        def sql(name):
            return lambda: connection.execute(f"CREATE OR REPLACE TEMP TABLE t AS {REGISTRY[name][1]}")

        out["duckdb"] = {name: timed(sql(name), runs) for name in names if REGISTRY[name][1]}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()

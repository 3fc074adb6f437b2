"""Headline queries, timed one by one on freshly built frames. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adkpi.registry.queries import QUERIES  # noqa: E402
from adkpi.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]


def run_once(spark, name: str) -> float:
    """Build and run one query in full; the result is discarded by the sink."""
    spark.catalog.clearCache()
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "adkpi-bench",
        master=f"local[{CPUS}]",
        shuffle_partitions=int(CPUS),
        conf={"spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up costs (class loading, first code generation) belong to no query.
    run_once(spark, "campaign_kpis")
    timings = {
        name: round(min(run_once(spark, name) for _ in range(REPEATS)), 3)
        for name in (ONLY or QUERIES)
    }
    spark.stop()
    result = {
        "metric": "total_query_time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

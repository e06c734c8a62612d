"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line.  Each query is built and executed in full through the
``noop`` sink (all rows computed, nothing collected to the driver), after one
warm-up run of each query on sf0.001 ($BENCH_WARM_DIR)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["order_lines_clean", "demand_groups", "quantile_backtest", "allocate_budget",
            "allocate_budget_units", "joint_orders", "no_fabrication", "baseline_comparison"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE

    from orderlab.plans import load_all
    from orderlab.session import local_session
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="orderlab-bench")
    reg = load_all()
    # warm-up of every measured query on the smallest data set (JVM start, JIT,
    # class loading, generated-code cache); the measured runs below then do all
    # of their work on $BENCH_SF_DIR
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for n in names:
        reg[n].build(spark, warm).write.format("noop").mode("overwrite").save()

    times = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

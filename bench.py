"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; its figure is the median in seconds. Governed
queries come with the same query ungoverned (raw), with row filters alone, with masks alone and with
both, and with the driver-side planning time alone."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from wardstone.plans.policy import load_policies
from wardstone.plans.session import Governance
from wardstone.queries import governed, surface

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
SECURED = {
    "scan": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "join": "SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey",
    "revenue": "SELECT c_mktsegment, o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment, o_orderpriority",
}
HEADLINE = ("q1_pricing", "q3_shipping", "q5_regions", "w2_frames", "a2_cube", "j12_range")
EVENTS = ("e7_sliding_count", "r15_baseline", "e12_alerts", "e9_profiles", "j7_asof")


def timed(run) -> float:
    run()
    out = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        out.append(time.perf_counter() - start)
    return round(statistics.median(out), 4)


def full(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries: dict[str, float] = {}
    views = surface.views(spark, SF_DIR)
    both = governed.governance(spark, SF_DIR)
    parts = {kind: Governance(spark, {t[2]: df for t, df in both.tables.items()}, [p for p in load_policies(governed.POLICIES) if p.kind == kind]) for kind in ("filter", "mask")}
    for name, sql in SECURED.items():
        queries[f"{name}_raw"] = timed(lambda: full(views.sql(sql)))
        for mode, g in {**parts, "both": both}.items():
            queries[f"{name}_{mode}"] = timed(lambda: full(g.secure_sql(governed.ANALYST, sql)))
        queries[f"{name}_planning"] = timed(lambda: both.plan(governed.ANALYST, sql))
    for name in HEADLINE:
        queries[name] = timed(lambda: full(surface.QUERIES[name](spark, SF_DIR)))
    for name in EVENTS:
        queries[name] = timed(lambda: full(governed.QUERIES[name](spark, SF_DIR)))
    print(json.dumps({"metric": "sum of median seconds over headline queries", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()

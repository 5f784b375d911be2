"""Benchmark: landing + ETL and the headline analytic queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line.  The store namespace is fresh for every run, so the
ETL (landing the feed from the star schema, cleaning, unpivot, population
join, rates, partitioned write) is measured, not served from a previous run.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top_areas", "overview_bundle", "kpi_totals", "insights", "weekly_pooled_rate",
    "endemic_channel", "zone_by_week", "pscore_by_area", "pscore_summary", "moving_average",
    "forecast_by_area", "forecast_kpis", "forecast_by_cause", "forecast_cause_kpis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("epiwatch-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(8, 2 * cpus)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.epiwatch.namespace", f"bench-{uuid.uuid4().hex[:12]}")

    from epiwatch.plans.catalog import QUERIES
    from epiwatch.sources import landing

    # Untimed session warm-up: tiny jobs (join, aggregate, partitioned Parquet
    # write and read-back into the run's own store folder) so class loading and
    # first code generation of the JVM are not charged to the first measured
    # step.  They touch none of the inputs.
    from epiwatch.sources.store import checkpoint_root
    warm = spark.range(20000).selectExpr("id % 97 AS k", "id AS v", "id % 3 AS p")
    warm_path = f"{checkpoint_root(spark)}/epiwatch/{spark.conf.get('spark.epiwatch.namespace')}/warmup"
    (warm.join(spark.range(97).withColumnRenamed("id", "k"), "k").groupBy("k", "p").sum("v")
     .write.mode("overwrite").partitionBy("p").parquet(warm_path))
    spark.read.parquet(warm_path).groupBy("p").count().collect()

    times: dict[str, float] = {}
    t = time.perf_counter()
    landing.raw_feed(spark, sf_dir)
    landing.population(spark, sf_dir)
    times["landing"] = time.perf_counter() - t
    t = time.perf_counter()
    landing.master(spark, sf_dir)
    times["etl"] = time.perf_counter() - t
    rows = {}
    for name in HEADLINE:
        t = time.perf_counter()
        rows[name] = len(QUERIES[name](spark, sf_dir).collect())
        times[name] = time.perf_counter() - t
    total = sum(times.values())
    print(json.dumps({"metric": "total_time_landing_etl_and_headline_queries", "value": round(total, 3),
                      "unit": "sec", "queries": {k: round(v, 3) for k, v in times.items()},
                      "rows": rows, "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

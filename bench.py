"""Headline queries, timed: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from capturelake import queries

HEADLINE = (
    "verdict_counts", "classify_samples", "fit_corrections", "quality_gates", "self_calibrate", "chain_cores", "verify_chains", "record_hashes",
    "search_log", "csv_export", "otsu_thresholds", "blob_moments",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[-1])  # starts the tasks' Python and compiles what all queries share; it is timed again below
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

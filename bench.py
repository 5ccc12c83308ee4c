"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from horosphere.plans import catalog
from horosphere.sources.ship import ship

HEADLINE = (
    "edges_canonical", "degree", "degree_distribution_ccdf", "triangles", "clustering_spectrum", "connected_components", "giant_component_edges",
    "vector_angle", "slerp_points", "chi_probability", "expected_degree", "loglikelihood_vertex", "pconn_histogram", "heat_kernel_weights",
    "laplacian_rows", "ensemble_class_stats", "cdf_lookup", "gap_lag_running_theta", "infer_kappas_class",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    queries, took = catalog.queries(), {}
    catalog.flagship(spark, sf).collect()  # starts the JVM's compilers and the Python workers
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

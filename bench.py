"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

#: The flagship grouping with its relatives: groupings, relations, metrics.
HEADLINE = ("induce_views", "kappa_per_case", "crosstab_long", "group_supported", "kappa_acts", "classical_dfg", "frequent_tdfg", "filter_infrequent", "enabled_heatmap", "nmi_vmeasure", "incoherence", "order_views", "kmeans_cf", "ward_cf", "word2vec_traces")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from optrail.plans.registry import QUERIES

    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(3):  # best of three, as the recorded numbers are
            spark.catalog.clearCache()  # nothing is kept from one run to the next
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(time.perf_counter() - begin, best or 1e9)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()

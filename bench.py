"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: cores. A query's time is that of
writing its whole result to nowhere, the session being warm.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomline.plans import registry

HEADLINE = [
    "x1_bm25_top10", "x2_like_top10", "x4_rrf_hybrid", "a16_flag_counts", "r3_semantic_ranks", "r5_semantic_rerank",
    "c1_split_articles", "s14_html_paragraphs", "u5_rebuild",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["m1_meta"](spark, sf_dir).collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

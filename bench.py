"""Times the headline queries over ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

#: The star queries; the operators over documents have the check tool.
HEADLINE = ("fused_sum_plain", "membership_count3", "membership_dup", "membership_multi_branch", "membership_ratio", "star_group_sum_count_avg", "star_group_decimal", "star_group_distinct", "star_rollup", "star_join_project", "star_join_fanout", "window_over_group", "topk_over_group", "union_regions", "group_space_encode")
WARM_UPS, RUNS = 1, 3


def main() -> None:
    from quillspark.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(WARM_UPS + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(median(took[WARM_UPS:]), 4)
    spark.stop()
    print(json.dumps({"metric": "sum of medians over the star queries", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Time the headline queries: python bench.py [NAME ...]

Reads the tables at $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS].  Every query is run
once to warm up and then timed; the whole result is computed, none of it is collected.
Prints one JSON line.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from gristmill.queries import REGISTRY

HEADLINE = (
    "clean_text", "clean_frame_report", "excel_guard", "combine_sources", "quarantine",
    "dedup_most_complete", "dedup_stats", "compare_matches", "compare_unique_left",
    "compare_stats", "match_fill", "search_cascading", "search_global",
    "facet_table", "facet_filter", "column_profile", "field_completeness",
    "distribution_top10", "split_summary", "trait_tags",
    "tfidf_topk", "fuzzy_match",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

"""Headline timings: one JSON line on stdout.

Each query runs once to warm up and is then timed (best of BENCH_REPEAT), written to the no-op sink so that every row
is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hist1d",
    "hist_many",
    "cutflow",
    "sel_dl",
    "sel_sl",
    "skim_dl_ee",
    "obj_muons",
    "obj_electrons",
    "obj_jets",
    "obj_fatjets",
    "os_pairs_same",
    "os_pairs_cross",
    "overlap_removal",
    "clean_lead2",
    "coll_sort",
    "syst_object",
    "weight_lookup",
    "met_shift",
    "lumi_certified",
    "stack_groups",
    "class_balance",
    "tail_repeat",
    "roc",
    "significance",
    "roc_pairwise",
    "score_hist",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from suite import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ["BENCH_QUERIES"].split(",") if "BENCH_QUERIES" in os.environ else HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    times = {}
    for name in names:
        runs = []
        for _ in range(1 + repeat):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:]), 3)
        print(name, [round(x, 2) for x in runs], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

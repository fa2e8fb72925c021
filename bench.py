"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line. Every query is run to the end into Spark's noop sink, after one warm-up."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from millrace import nexmark
from millrace.queries import QUERIES
from millrace.sources import discard

#: Rows of the generated workload, as in the published figures.
ROWS = int(os.environ.get("BENCH_ROWS", 2_000_000))
TABLES = ["filter_map", "group_by_key", "group_by_merge", "global_aggs", "dim_join_inner", "dim_join_multi", "evt_tumbling", "evt_hop", "evt_session", "interval_join", "count_tumbling", "count_sliding", "top_n_per_key", "dedup_window", "flat_map_words"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: lambda n=name: QUERIES[n](spark, sf_dir) for name in TABLES}
    todo |= {f"nexmark_q{i}": lambda n=f"q{i}": nexmark.run(spark, n, ROWS) for i in range(23)}
    discard(QUERIES["evt_tumbling"](spark, sf_dir))
    took = {}
    for name, make in todo.items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        best = None
        for _ in range(2):
            start = time.perf_counter()
            discard(make())
            best = min(best or 1e9, time.perf_counter() - start)
        took[name] = round(best, 3)
    rates = {k: round(ROWS / v) for k, v in took.items() if k.startswith("nexmark_")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows_per_second": rates}))


if __name__ == "__main__":
    main()

"""Headline timings: one JSON line.

Data from $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS] (default 8). The
index is built first and timed as `index_build`; the other queries read it,
as a search job would. Each query runs once to warm up, then BENCH_RUNS times
(default 1); the median is reported. A run covers planning, query-side
look-ups, and writing the whole result to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import bindings as B  # noqa: E402
from checks.queries import queries  # noqa: E402
from findrift.session import build_session  # noqa: E402

HEADLINE = (
    "bm25_match", "fuzzy_expand", "bool_should", "search", "search_totals", "facet_genres",
    "similar_docs", "autocomplete", "browse", "genres_overview", "lookup_by_id", "build_postings",
    "tokens_english", "normalize_detail", "upsert_by_id", "log_append", "log_postings",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    B.catalog(spark, sf).count()  # start-up is not part of any timing
    times = {}
    t = time.perf_counter()
    B.index(spark, sf)
    times["index_build"] = round(time.perf_counter() - t, 3)
    for name in names:
        fn = queries()[name]
        run(fn(spark, sf))
        taken = []
        for _ in range(runs):
            t = time.perf_counter()
            run(fn(spark, sf))
            taken.append(time.perf_counter() - t)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)$", sf)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
